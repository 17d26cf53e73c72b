"""Values that results depend on.

Fixed values: formats, default names and default parameters, stated as they must be.
"""

PART_PREFIX = "[{role}]: "
PART_SEPARATOR = "\n\n"
TOOL_CALL = "<tool_call>\n{name}({arguments})\n</tool_call>"
TOOL_CALL_SEPARATOR = "\n"
TOOL_RESPONSE = '<tool_response name="{name}">\n{content}\n</tool_response>'
UNKNOWN_FUNCTION = "unknown"
UNNAMED_TOOL = "tool"
NO_ARGUMENTS = "{}"

GOLD_RESOLVED = 1
GOLD_EXIT_STATUS = "submit"
MIN_CHARS = 100
MIN_TOKENS = 100

LOGITS = "logits"
LOGPROBS = "logprobs"
TOP_K = 128
SCORER_BATCH = 8
CHUNK_POSITIONS = 1024
MEAN_EPSILON = 1e-8

MAX_PROMPT_TOKENS = 512
MAX_TRAJECTORY_TOKENS = 8192
PAD_ID = 0
VALIDATION_FRACTION = 0.05
SEED = 42
