"""The registered queries as plain SQL on the given tables, written in long form."""

from __future__ import annotations

TOKEN = "[A-Za-z0-9_]+|[^A-Za-z0-9_]"
SEP = "chr(10) || chr(10)"


#: Read by several others: worked out once, or the database repeats them for each reader.
_SHARED = {"tok", "dict", "masked", "best", "enc", "teacher"}


def _with(ctes: dict[str, str], select: str) -> str:
    def clause(name: str) -> str:
        return f"{name} AS {'MATERIALIZED ' if name in _SHARED else ''}({ctes[name]})"

    return "WITH " + ",\n".join(map(clause, ctes)) + "\n" + select


# ---- conversations ----------------------------------------------------------------------

_HEADERS = {
    "flag": """
        SELECT CAST(doc_id AS VARCHAR) AS trajectory_id, quality AS resolved,
               CASE WHEN toxic = 0 THEN 'submit' WHEN toxic = 1 THEN 'error' END AS exit_status
        FROM labels""",
    "allmsg": """
        SELECT CAST(conv_id AS VARCHAR) AS trajectory_id, CAST(turn AS INTEGER) AS msg_idx, role, text AS content
        FROM conversations""",
    "hdr": """
        SELECT m.trajectory_id, m.n_messages, f.resolved, f.exit_status
        FROM (SELECT trajectory_id, count(*) AS n_messages FROM allmsg GROUP BY 1) m
        LEFT JOIN flag f USING (trajectory_id)""",
    "gold": "SELECT * FROM hdr WHERE resolved = 1 AND exit_status = 'submit'",
}


def _parts(source: str, prefix: str = "'[' || coalesce(role, '') || ']: '", suffix: str = "''", sep: int = 2) -> dict[str, str]:
    """Parts with offsets from a message table that is already in scope."""
    return {
        "part": f"""
            SELECT trajectory_id, msg_idx, coalesce(role, '') AS role, {prefix} || content || {suffix} AS part
            FROM {source} WHERE coalesce(content, '') <> ''""",
        "placed": f"""
            SELECT *, CAST(coalesce(sum(length(part) + {sep}) OVER (PARTITION BY trajectory_id ORDER BY msg_idx
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
                   CAST(sum(length(part) + {sep}) OVER (PARTITION BY trajectory_id) - {sep} AS BIGINT) AS n_chars
            FROM part""",
        "located": "SELECT *, char_start + length(part) AS char_end FROM placed",
    }


def _tokens() -> dict[str, str]:
    """Whole texts, their tokens with offsets, and the overlap of tokens with assistant parts."""
    return {
        "txt": f"SELECT trajectory_id, string_agg(part, {SEP} ORDER BY msg_idx) AS text FROM part GROUP BY 1",
        "toks": f"SELECT trajectory_id, regexp_extract_all(text, '{TOKEN}') AS ts FROM txt",
        "tok0": """
            SELECT trajectory_id, unnest(ts) AS token, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS pos FROM toks""",
        "tok": """
            SELECT *, CAST(coalesce(sum(length(token)) OVER (PARTITION BY trajectory_id ORDER BY pos
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tok_start,
                   lag(token) OVER (PARTITION BY trajectory_id ORDER BY pos) AS prev
            FROM tok0""",
        "masked": """
            SELECT t.*, CAST(EXISTS (SELECT 1 FROM located a WHERE a.trajectory_id = t.trajectory_id
                        AND a.role = 'assistant' AND t.tok_start < a.char_end
                        AND t.tok_start + length(t.token) > a.char_start) AS INTEGER) AS loss_mask
            FROM tok t""",
        "bound": """
            SELECT trajectory_id, coalesce(min(CASE WHEN role = 'assistant' THEN char_start END), max(char_end)) AS b
            FROM located GROUP BY 1""",
        "btok": """
            SELECT t.trajectory_id, CAST(coalesce(min(CASE WHEN t.tok_start >= b.b THEN t.pos END), count(*)) AS BIGINT)
                     AS prompt_boundary, count(*) AS n_tokens
            FROM tok t JOIN bound b USING (trajectory_id) GROUP BY 1""",
        "dict": """
            SELECT token, count(*) AS n,
                   CAST(row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS INTEGER) AS token_id
            FROM tok GROUP BY token""",
        "enc": "SELECT m.*, d.token_id FROM masked m JOIN dict d USING (token)",
    }


_GOLD = {
    **_HEADERS,
    "goldmsg": "SELECT m.* FROM allmsg m WHERE trajectory_id IN (SELECT trajectory_id FROM gold)",
    **_parts("goldmsg"),
    **_tokens(),
}
_ALL = {**_HEADERS, **_parts("allmsg"), **_tokens()}

# Count-based scores over all conversations, one row per listed id.
_COUNTS = {
    **_ALL,
    "pairs": "SELECT prev, token, count(*) AS n_pair FROM tok WHERE pos > 0 GROUP BY 1, 2",
    "ranked": """
        SELECT prev, token, ln(n_pair / sum(n_pair) OVER (PARTITION BY prev)) AS val,
               row_number() OVER (PARTITION BY prev ORDER BY n_pair DESC, token) AS rank
        FROM pairs""",
    "best": """
        SELECT r.prev, r.rank, r.val, d.token_id,
               ln((d.n + 1.0::DOUBLE) / (SELECT sum(n) + count(*) FROM dict)) AS logq
        FROM ranked r JOIN dict d USING (token) WHERE r.rank <= 8""",
    "teacher": """
        SELECT e.trajectory_id, e.pos, e.loss_mask, e.token_id, b.rank, b.val, b.token_id AS id, b.logq
        FROM enc e JOIN best b ON b.prev = e.prev WHERE e.pos > 0""",
    "prob": """
        SELECT *, exp(val) / sum(exp(val)) OVER (PARTITION BY trajectory_id, pos) AS p FROM teacher""",
    "kl": """
        SELECT trajectory_id, pos, any_value(loss_mask) AS loss_mask, sum(p * (ln(p) - logq)) AS kl
        FROM prob GROUP BY 1, 2""",
    "sums": """
        SELECT trajectory_id, sum(kl * loss_mask) AS kl_sum, CAST(sum(loss_mask) AS BIGINT) AS n_masked
        FROM kl GROUP BY 1""",
    "shuffled": """
        SELECT trajectory_id, CAST(row_number() OVER (ORDER BY md5('42:0:' || trajectory_id)) - 1 AS BIGINT) AS idx
        FROM hdr""",
    "batched": "SELECT s.*, o.idx // 8 AS batch_id FROM sums s JOIN shuffled o USING (trajectory_id)",
}

# ---- documents --------------------------------------------------------------------------

_DOCS = {
    "flag": _HEADERS["flag"],
    "line": """
        SELECT CAST(doc_id AS VARCHAR) AS trajectory_id, lang || '-' || doc_id AS instance_id, source AS repo,
               unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
        FROM documents""",
    "docmsg": """
        SELECT l.trajectory_id, CAST(i AS INTEGER) AS msg_idx,
               CASE WHEN i = 0 THEN 'system' WHEN i % 3 = 1 THEN 'user' WHEN i % 3 = 2 THEN 'assistant' ELSE 'tool' END AS role,
               CASE WHEN i % 3 = 2 AND i % 4 = 0 THEN NULL ELSE line END AS content,
               CASE WHEN i % 3 = 0 AND i % 2 = 1 THEN 'shell' END AS name,
               i % 3 = 2 AND i % 2 = 0 AS calling, instance_id, repo, f.resolved, f.exit_status
        FROM line l LEFT JOIN flag f USING (trajectory_id)""",
    "args": """
        SELECT trajectory_id, msg_idx, role, calling,
               CASE WHEN msg_idx % 10 = 0 THEN '"ls \\"src\\""'
                    ELSE '{"line": ' || msg_idx || ', "deep": [1, 2.5]}' END AS first_args,
               CASE WHEN msg_idx % 4 = 0 THEN 'edit' ELSE 'unknown' END AS first_name, content
        FROM docmsg""",
    "called": """
        SELECT trajectory_id, msg_idx,
               coalesce(content, '')
               || CASE WHEN msg_idx > 2 THEN '<tool_call>' || chr(10) || first_name || '(' || first_args || ')' || chr(10)
                                             || '</tool_call>' || chr(10) ELSE '' END
               || '<tool_call>' || chr(10) || 'view({})' || chr(10) || '</tool_call>' AS content
        FROM args WHERE calling""",
    "answered": """
        SELECT trajectory_id, msg_idx, '<tool_response name="' || coalesce(name, 'tool') || '">' || chr(10)
               || coalesce(content, '') || chr(10) || '</tool_response>' AS content
        FROM docmsg WHERE role = 'tool'""",
    "toolmsg": """
        SELECT d.trajectory_id, d.msg_idx, CASE WHEN d.role = 'tool' THEN 'user' ELSE d.role END AS role,
               coalesce(c.content, a.content, d.content) AS content, d.instance_id, d.repo, d.resolved, d.exit_status
        FROM docmsg d LEFT JOIN called c USING (trajectory_id, msg_idx)
        LEFT JOIN answered a USING (trajectory_id, msg_idx)""",
}
_DOCPARTS = {**_DOCS, **_parts("docmsg")}
_GOLDDOC = "resolved = 1 AND exit_status = 'submit'"

_TOOLTOKENS = {
    **_DOCS,
    "goldtool": f"SELECT * FROM toolmsg WHERE {_GOLDDOC}",
    **_parts("goldtool"),
    "txt": _tokens()["txt"],
    "toks": f"SELECT trajectory_id, regexp_extract_all(text, '{TOKEN}')[1:8192] AS ts FROM txt",
    "kept": "SELECT * FROM toks WHERE len(ts) >= 100",
    "tok": "SELECT trajectory_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM kept",
    "dict": _tokens()["dict"],
    "sample": """
        SELECT t.trajectory_id, CAST(count(*) AS INTEGER) AS n_tokens, string_agg(d.token_id, ',' ORDER BY t.pos) AS input_ids
        FROM tok t JOIN dict d USING (token) GROUP BY 1""",
    "names": "SELECT DISTINCT trajectory_id, instance_id, repo FROM docmsg",
}

# ---- embeddings -------------------------------------------------------------------------

_DENSE = {
    "vec": """
        SELECT vec_id, CAST(vec_id // 50 AS VARCHAR) AS trajectory_id, CAST(vec_id % 50 AS INTEGER) AS pos,
               label % 2 AS loss_mask, label, embedding FROM embeddings""",
    "tz": """
        SELECT vec_id, trajectory_id, pos, loss_mask, CAST(unnest(embedding) AS DOUBLE) AS z,
               generate_subscripts(embedding, 1) - 1 AS id FROM vec""",
    "sz": """
        SELECT (vec_id + n - 1) % n AS vec_id, CAST(unnest(embedding) AS DOUBLE) AS z,
               generate_subscripts(embedding, 1) - 1 AS id
        FROM vec, (SELECT max(vec_id) + 1 AS n FROM embeddings)""",
    "slse": "SELECT vec_id, ln(sum(exp(z / 2))) AS lse FROM sz GROUP BY 1",
    "top": """
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, id) AS INTEGER) AS rank FROM tz)
        WHERE rank <= 8""",
    "top_p": "SELECT *, exp(z / 2) / sum(exp(z / 2)) OVER (PARTITION BY vec_id) AS p FROM top",
    "dkl": """
        SELECT t.vec_id, t.trajectory_id, t.pos, any_value(t.loss_mask) AS loss_mask,
               min(CASE WHEN t.rank = 1 THEN t.id END) AS best_id,
               sum(t.p * (ln(t.p) - (s.z / 2 - l.lse))) AS kl
        FROM top_p t JOIN sz s ON s.vec_id = t.vec_id AND s.id = t.id JOIN slse l ON l.vec_id = t.vec_id
        GROUP BY 1, 2, 3""",
    "top2": "SELECT * FROM top WHERE rank <= 2",
    "scored": """
        SELECT trajectory_id, least(50, 20 + CAST(sum(loss_mask) AS INTEGER)) AS n_scored FROM vec GROUP BY 1""",
}

# ---- events -----------------------------------------------------------------------------

_STEPS = {
    "stepped": """
        SELECT user_id AS run_id, value AS loss,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s FROM events""",
    "steps": "SELECT run_id, s // 10 AS epoch, s % 10 AS step, loss FROM stepped",
    "epochs": "SELECT run_id, epoch, round(avg(loss), 6) AS val_loss FROM steps GROUP BY 1, 2",
}

_MEAN = "round(sum(kl * loss_mask) / (sum(loss_mask) + 1e-8), 6) AS loss, CAST(sum(loss_mask) AS BIGINT) AS n_masked"

# Scores of the echo scorer: three ids per position after the first.
_ECHO = {
    **_GOLD,
    "echo": """
        SELECT trajectory_id, pos, token_id AS id, -0.5::DOUBLE - pos % 3 AS val FROM enc WHERE pos > 0
        UNION ALL SELECT trajectory_id, pos, token_id + 1, -1.0::DOUBLE FROM enc WHERE pos > 0
        UNION ALL SELECT trajectory_id, pos, token_id + 2, -0.25::DOUBLE * (token_id % 8) FROM enc WHERE pos > 0""",
    "echo2": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id, pos ORDER BY val DESC, id) AS rank FROM echo)
        WHERE rank <= 2""",
    "echopos": """
        SELECT trajectory_id, pos, string_agg(id, ',' ORDER BY rank) AS top_ids, sum(val) AS val_sum,
               min(CASE WHEN rank = 1 THEN id END) AS best_id
        FROM echo2 GROUP BY 1, 2""",
}

_WORD = "[^ \\t\\n]+|[ \\t\\n]+"


def _prompt(limit: str) -> str:
    return _with(
        _ALL,
        f"""SELECT trajectory_id,
               array_to_string(list_transform(range(64), lambda i: CASE WHEN i < least({limit}, 64, len(ids)) THEN ids[i + 1] ELSE -1 END), ',') AS prompt_ids,
               array_to_string(list_transform(range(64), lambda i: CASE WHEN i < least({limit}, 64, len(ids)) THEN 1 ELSE 0 END), '') AS prompt_mask
        FROM (SELECT trajectory_id, list(token_id ORDER BY pos) AS ids FROM enc GROUP BY 1) JOIN btok USING (trajectory_id)""",
    )


_CACHE_ROWS = {
    **_COUNTS,
    "scores": """
        SELECT trajectory_id, pos, string_agg(id, ',' ORDER BY rank) AS top_ids,
               round(sum(CAST(CAST(val AS FLOAT) AS DOUBLE)), 4) AS val_sum
        FROM teacher GROUP BY 1, 2""",
}


def _hash_order(source: str, seed: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY md5('{seed}:' || trajectory_id)) - 1 AS BIGINT) AS idx FROM {source}"


def _sides(epoch: str) -> dict[str, str]:
    """Split and batches: training is shuffled by epoch, validation keeps its order."""
    return {
        "ordered": f"SELECT trajectory_id, {_hash_order('hdr', '42')}",
        "sides": """
            SELECT trajectory_id, CASE WHEN idx < greatest(1, floor((SELECT count(*) FROM hdr) * 0.05::DOUBLE))
                                       THEN 'val' ELSE 'train' END AS split FROM ordered""",
        "rowed": f"""
            SELECT *, row_number() OVER (PARTITION BY split ORDER BY
                          CASE WHEN split = 'train' THEN md5('42:{epoch}:' || trajectory_id)
                               ELSE md5('42:' || trajectory_id) END) - 1 AS i FROM sides""",
        "numbered": """
            SELECT trajectory_id, split, CAST(i // 8 AS BIGINT) AS batch_id, CAST(i % 8 AS INTEGER) AS slot FROM rowed""",
    }


def all_oracles() -> dict[str, str]:
    doc_headers = """SELECT trajectory_id, instance_id, repo, resolved, exit_status, CAST(count(*) AS INTEGER) AS n_messages
                     FROM docmsg"""
    samples = _with(
        _TOOLTOKENS,
        "SELECT trajectory_id, instance_id, repo, n_tokens, input_ids FROM sample JOIN names USING (trajectory_id)",
    )
    found = {
        "s1_load_trajectories": _with(
            {**_DOCS},
            """SELECT CAST(d.doc_id AS VARCHAR) AS trajectory_id, lang || '-' || d.doc_id AS instance_id, source AS repo,
                      f.resolved, f.exit_status, m.n_messages, m.n_chars
               FROM documents d LEFT JOIN flag f ON f.trajectory_id = CAST(d.doc_id AS VARCHAR)
               LEFT JOIN (SELECT trajectory_id, CAST(count(*) AS INTEGER) AS n_messages,
                                 CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS n_chars
                          FROM docmsg GROUP BY 1) m ON m.trajectory_id = CAST(d.doc_id AS VARCHAR)""",
        ),
        "s2_load_gold": _with(
            _DOCS,
            f"""SELECT trajectory_id, msg_idx, role, name, CAST(length(content) AS INTEGER) AS n_chars,
                       CASE WHEN calling THEN 3 END AS n_calls
                FROM docmsg WHERE {_GOLDDOC}""",
        ),
        "s3_write_gold": _with(_DOCS, f"{doc_headers} WHERE {_GOLDDOC} GROUP BY ALL"),
        "s4_write_tokenized": samples,
        "s5_read_tokenized": _with(_TOOLTOKENS, "SELECT trajectory_id, n_tokens FROM sample"),
        "s6_write_cache": _with(
            _ALL,
            """SELECT trajectory_id, CAST(n_tokens AS INTEGER) AS seq_len, 'logprobs' AS format,
                      CAST(prompt_boundary AS INTEGER) AS prompt_boundary, true AS has_loss_mask,
                      'counts' AS run_id FROM btok""",
        ),
        "s7_read_cache": _with(
            _CACHE_ROWS,
            """SELECT e.trajectory_id, CAST(e.pos // 1024 AS INTEGER) AS chunk, e.pos, e.token_id,
                      CASE WHEN s.top_ids IS NULL THEN 0 ELSE e.loss_mask END AS loss_mask,
                      CAST(s.top_ids IS NOT NULL AS INTEGER) AS is_valid, s.top_ids, s.val_sum
               FROM enc e LEFT JOIN scores s USING (trajectory_id, pos)""",
        ),
        "s8_npz_import": _with(
            _DENSE,
            """SELECT trajectory_id, 0 AS chunk, pos, label AS token_id, loss_mask,
                      CAST(count(*) OVER (PARTITION BY trajectory_id) // 2 AS INTEGER) AS prompt_boundary,
                      'logits' AS format, array_to_string(range(len(embedding)), ',') AS top_ids,
                      array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS INTEGER)), ',') AS top_vals
               FROM vec""",
        ),
        "s9_resume": _with(
            _ALL,
            """SELECT trajectory_id, CASE WHEN trajectory_id IN (SELECT trajectory_id FROM gold) THEN 'first' ELSE 'second' END AS run_id,
                      CAST(n_tokens AS INTEGER) AS seq_len FROM btok""",
        ),
        "s10_source_choice": _with(
            {**_TOOLTOKENS, **{k: _HEADERS[k] for k in ("allmsg", "hdr", "gold")}},
            """SELECT 'raw' AS source, count(*) AS n_trajectories FROM sample
               UNION ALL SELECT 'tokenized', count(*) FROM sample
               UNION ALL SELECT 'cache', count(*) FROM gold""",
        ),
        "s7_two_runs": _with(
            _ALL, "SELECT trajectory_id, count(*) AS n_positions, 'counts' AS run_id FROM enc GROUP BY 1"
        ),
        "s11_cache_summary": _with(
            _HEADERS,
            """SELECT count(*) AS n_trajectories, count(*) FILTER (WHERE CAST(trajectory_id AS BIGINT) % 2 = 1) AS n_without_mask,
                      count(DISTINCT CAST(trajectory_id AS BIGINT) % 2) AS n_files, true AS has_bytes FROM hdr""",
        ),
        "s1_broken_lines": """
            SELECT 'read' AS kind, count(*) FILTER (WHERE doc_id % 7 <> 0) AS n FROM documents
            UNION ALL SELECT 'broken', count(*) FILTER (WHERE doc_id % 7 = 0) FROM documents""",
        "s1_checked_ids": _with(
            _DOCS,
            """SELECT lang || '-' || d.doc_id AS instance_id,
                      CASE WHEN d.doc_id % 7 <> 0 THEN CASE WHEN d.doc_id % 3 = 0 THEN 'shared' ELSE CAST(d.doc_id AS VARCHAR) END END
                          AS trajectory_id,
                      CASE WHEN d.doc_id % 7 = 0 THEN 'missing' WHEN d.doc_id % 3 = 0 THEN 'repeated' ELSE 'none' END AS id_fault,
                      m.n_messages
               FROM documents d
               LEFT JOIN (SELECT trajectory_id, CAST(count(*) AS INTEGER) AS n_messages FROM docmsg GROUP BY 1) m
                 ON m.trajectory_id = CAST(d.doc_id AS VARCHAR)""",
        ),
        "s4_user_tokenizer": _with(
            {
                **_DOCS,
                **_parts("toolmsg"),
                "txt": _tokens()["txt"],
                "ws": f"SELECT trajectory_id, regexp_extract_all(text, '{_WORD}')[1:8192] AS ws FROM txt",
            },
            """SELECT trajectory_id, CAST(len(ws) AS INTEGER) AS n_tokens,
                      array_to_string(list_transform(ws, lambda w: length(w)), ',') AS input_ids
               FROM ws WHERE len(ws) >= 100""",
        ),
        "s13_malformed_scores": _with(
            _ALL,
            """SELECT trajectory_id, CASE WHEN n_tokens % 5 = 4 THEN 'ok' ELSE 'error' END AS status,
                      CASE WHEN n_tokens % 5 = 4 THEN n_tokens ELSE 0 END AS n_positions FROM btok""",
        ),
        "t1_tokenize_documents": _with(
            {**_DOCPARTS, "txt": _tokens()["txt"], "toks": _tokens()["toks"], "tok0": _tokens()["tok0"]},
            """SELECT trajectory_id, count(*) AS n_tokens, CAST(sum(length(token)) AS BIGINT) AS n_chars,
                      count(DISTINCT token) AS n_distinct FROM tok0 GROUP BY 1""",
        ),
        "t7_truncate_documents": _with(
            {**_DOCPARTS, "txt": _tokens()["txt"], "toks": _tokens()["toks"], "tok0": _tokens()["tok0"]},
            """SELECT trajectory_id, count(*) AS n_tokens, CAST(sum((pos + 1) * length(token)) AS BIGINT) AS weighed
               FROM tok0 WHERE pos < 512 GROUP BY 1""",
        ),
        "t2_unknown_token": _with(
            {
                **_ALL,
                "golddict": """
                    SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS token_id
                    FROM tok WHERE trajectory_id IN (SELECT trajectory_id FROM gold) GROUP BY token""",
                "known": """
                    SELECT t.trajectory_id, t.pos, coalesce(d.token_id, 999999) AS token_id
                    FROM tok t LEFT JOIN golddict d USING (token)""",
            },
            """SELECT trajectory_id, CAST(count(*) AS INTEGER) AS n_tokens,
                      CAST(count(*) FILTER (WHERE token_id = 999999) AS INTEGER) AS n_unknown,
                      string_agg(token_id, ',' ORDER BY pos) AS input_ids FROM known GROUP BY 1""",
        ),
        "k8_gather_wide": _with(
            _DENSE,
            """SELECT v.trajectory_id, v.pos, 0 AS n_missing, round(sum(s.z / 2 - l.lse), 5) AS logp_sum,
                      round(max(CASE WHEN s.id = b.id THEN s.z / 2 - l.lse END), 6) AS logp_best
               FROM vec v JOIN sz s USING (vec_id) JOIN slse l USING (vec_id)
               JOIN (SELECT vec_id, id FROM top WHERE rank = 1) b USING (vec_id) GROUP BY 1, 2""",
        ),
        "a3_accumulated_loss": _with(
            _STEPS,
            """SELECT run_id, epoch, step, loss, round(avg_loss, 6) AS avg_loss
               FROM (SELECT *, avg(loss) OVER (PARTITION BY run_id, epoch ORDER BY step
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS avg_loss FROM steps)
               WHERE (step + 1) % 3 = 0 AND (step + 1) % 2 = 0""",
        ),
        "s13_quarantine": _with(
            _GOLD,
            """SELECT trajectory_id, CASE WHEN n_tokens > 1200 THEN 0 ELSE n_tokens END AS n_positions,
                      CASE WHEN n_tokens > 1200 THEN 'error' ELSE 'ok' END AS status,
                      CASE WHEN n_tokens > 1200 THEN 'ValueError: ' || n_tokens || ' tokens' END AS error
               FROM btok""",
        ),
        "f1_gold_filter": _with(_HEADERS, "SELECT trajectory_id, n_messages, resolved, exit_status FROM gold"),
        "f2_first_n": _with(
            _HEADERS, "SELECT trajectory_id, n_messages FROM gold ORDER BY trajectory_id LIMIT 20"
        ),
        "f2_selected": _with(
            _HEADERS,
            """SELECT 'few' AS part, trajectory_id FROM (SELECT trajectory_id FROM gold ORDER BY trajectory_id LIMIT 20)
               UNION ALL
               SELECT 'half', key FROM (SELECT 'event-' || event_id AS key, row_number() OVER (ORDER BY 'event-' || event_id) AS r
                                        FROM events) WHERE r <= (SELECT count(*) // 2 FROM events)""",
        ),
        "f3_with_messages": _with(
            _DOCS, """SELECT trajectory_id, CAST(count(*) AS INTEGER) AS n_messages FROM docmsg
               WHERE resolved IS NOT NULL AND content <> '' GROUP BY 1"""
        ),
        "f4_drop_empty_messages": _with(
            _DOCS,
            """SELECT trajectory_id, msg_idx, role, CAST(length(content) AS INTEGER) AS n_chars
               FROM docmsg WHERE content IS NOT NULL AND content <> ''""",
        ),
        "f5_min_chars": _with(
            _ALL,
            "SELECT trajectory_id, CAST(length(text) AS BIGINT) AS n_chars FROM txt WHERE length(text) >= 1000",
        ),
        "f6_min_tokens": _with(
            _ALL, "SELECT trajectory_id, least(n_tokens, 512) AS n_tokens FROM btok WHERE least(n_tokens, 512) >= 500"
        ),
        "f7_vanished_trajectories": _with(
            _DOCS, "SELECT trajectory_id, count(*) AS n_kept FROM docmsg WHERE coalesce(content, '') <> '' GROUP BY 1"
        ),
        "m1_flatten_tool_calls": _with(
            _DOCS,
            """SELECT d.trajectory_id, d.msg_idx, CASE WHEN d.calling THEN c.content ELSE d.content END AS content
               FROM docmsg d LEFT JOIN called c USING (trajectory_id, msg_idx) WHERE d.role = 'assistant'""",
        ),
        "m2_normalise_arguments": _with(
            _DOCS,
            """SELECT trajectory_id, msg_idx, 0 AS call_idx, first_args AS arguments FROM args WHERE calling AND msg_idx > 2
               UNION ALL
               SELECT trajectory_id, msg_idx, CASE WHEN msg_idx > 2 THEN 1 ELSE 0 END, '{}' FROM args WHERE calling""",
        ),
        "m3_wrap_tool_responses": _with(_DOCS, "SELECT trajectory_id, msg_idx, content FROM answered"),
        "m4_remap_tool_role": _with(
            _DOCS,
            """SELECT trajectory_id, msg_idx, role AS kept, CASE role WHEN 'tool' THEN 'user' ELSE role END AS mapped
               FROM docmsg""",
        ),
        "m5_render_text": _with(
            _DOCPARTS,
            f"""SELECT d.trajectory_id, coalesce(t.text, '') AS text, coalesce(t.b, 0) AS prompt_boundary_char
                FROM (SELECT DISTINCT trajectory_id FROM docmsg) d
                LEFT JOIN (SELECT trajectory_id, string_agg(part, {SEP} ORDER BY msg_idx) AS text,
                                  coalesce(min(CASE WHEN role = 'assistant' THEN char_start END), max(char_end)) AS b
                           FROM located GROUP BY 1) t USING (trajectory_id)""",
        ),
        "m5_render_parts": _with(
            {**_HEADERS, **_parts("allmsg")},
            "SELECT trajectory_id, msg_idx, role, part, char_start, char_end, n_chars FROM located",
        ),
        "m6_render_trailing": _with(
            _DOCPARTS,
            """SELECT trajectory_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest
               FROM (SELECT trajectory_id, string_agg(part || chr(10) || chr(10), '' ORDER BY msg_idx) AS text
                     FROM part GROUP BY 1) WHERE length(text) >= 100""",
        ),
        "m7_render_template": _with(
            {
                **_DOCS,
                **_parts("toolmsg", "'<|im_start|>' || role || chr(10)", "'<|im_end|>' || chr(10)", 0),
            },
            "SELECT trajectory_id, msg_idx, part, char_start, char_end, n_chars FROM located",
        ),
        "m8_assistant_ranges": _with(
            {**_HEADERS, **_parts("allmsg")},
            "SELECT trajectory_id, msg_idx, char_start, char_end FROM located WHERE role = 'assistant'",
        ),
        "m9_prompt_boundary": _with(
            _ALL,
            """SELECT b.trajectory_id, b.b AS prompt_boundary_char, CAST(length(t.text) AS BIGINT) AS n_chars
               FROM bound b JOIN txt t USING (trajectory_id)""",
        ),
        "rendered_gold": _with(
            _GOLD,
            """SELECT l.trajectory_id, CAST(length(any_value(t.text)) AS BIGINT) AS n_chars, count(*) AS n_parts,
                      round(sum(CASE WHEN role = 'assistant' THEN length(part) ELSE 0 END) / length(any_value(t.text)), 6) AS assistant_share,
                      any_value(b.b) AS prompt_boundary_char
               FROM located l JOIN txt t USING (trajectory_id) JOIN bound b USING (trajectory_id)
               WHERE length(t.text) >= 100 GROUP BY 1""",
        ),
        "t1_tokenize": _with(
            _ALL, "SELECT trajectory_id, pos, token, tok_start, tok_start + length(token) AS tok_end FROM tok"
        ),
        "t2_dictionary": _with(_ALL, "SELECT token, n, token_id FROM dict"),
        "t3_loss_mask": _with(_ALL, "SELECT trajectory_id, pos, loss_mask FROM masked"),
        "t2_wide_lookup": _with(
            _ALL, "SELECT t.trajectory_id, t.pos, t.token, d.token_id FROM tok t LEFT JOIN dict d USING (token)"
        ),
        "t1_windowed_tokenizer": _with(
            {
                **_DOCS,
                **_parts("toolmsg"),
                "txt": _tokens()["txt"],
                "w0": f"""
                    SELECT trajectory_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos
                    FROM (SELECT trajectory_id, regexp_extract_all(text, '{_WORD}') AS ws FROM txt)""",
                "w": """
                    SELECT *, coalesce(sum(length(w)) OVER (PARTITION BY trajectory_id ORDER BY pos
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w0""",
                "wm": """
                    SELECT w.*, CAST(EXISTS (SELECT 1 FROM located a WHERE a.trajectory_id = w.trajectory_id
                           AND a.role = 'assistant' AND w.s < a.char_end AND w.s + length(w.w) > a.char_start) AS INTEGER) AS m
                    FROM w""",
            },
            """SELECT trajectory_id, pos // 512 AS block, string_agg(length(w), ',' ORDER BY pos) AS input_ids,
                      string_agg(m, '' ORDER BY pos) AS loss_mask, CAST(min(s) AS BIGINT) AS first_char
               FROM wm GROUP BY 1, 2""",
        ),
        "t3_overlap_mask": _with(
            {
                **_DOCPARTS,
                "txt": f"""
                    SELECT d.trajectory_id, coalesce(t.text, '') AS text, coalesce(t.b, 0) AS b
                    FROM (SELECT DISTINCT trajectory_id FROM docmsg) d
                    LEFT JOIN (SELECT trajectory_id, string_agg(part, {SEP} ORDER BY msg_idx) AS text,
                                      coalesce(min(CASE WHEN role = 'assistant' THEN char_start END), max(char_end)) AS b
                               FROM located GROUP BY 1) t USING (trajectory_id)""",
                "w0": f"""
                    SELECT trajectory_id, b, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos
                    FROM (SELECT trajectory_id, b, regexp_extract_all(text, '{_WORD}') AS ws FROM txt)""",
                "w": """
                    SELECT *, coalesce(sum(length(w)) OVER (PARTITION BY trajectory_id ORDER BY pos
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w0""",
                "wm": """
                    SELECT w.*, CAST(EXISTS (SELECT 1 FROM located a WHERE a.trajectory_id = w.trajectory_id
                           AND a.role = 'assistant' AND w.s < a.char_end AND w.s + length(w.w) > a.char_start) AS INTEGER) AS m
                    FROM w""",
            },
            """SELECT d.trajectory_id, coalesce(g.n, 0) AS n_tokens, coalesce(g.loss_mask, '') AS loss_mask,
                      coalesce(g.prompt_boundary, 0) AS prompt_boundary
               FROM txt d LEFT JOIN (
                   SELECT trajectory_id, CAST(count(*) AS INTEGER) AS n, string_agg(m, '' ORDER BY pos) AS loss_mask,
                          CAST(coalesce(min(CASE WHEN s >= b THEN pos END), count(*)) AS INTEGER) AS prompt_boundary
                   FROM wm GROUP BY 1) g USING (trajectory_id)""",
        ),
        "t4_prompt_boundary_token": _with(_ALL, "SELECT trajectory_id, prompt_boundary, n_tokens FROM btok"),
        "t5_valid_mask": _with(
            _ALL,
            """SELECT trajectory_id, pos, CASE WHEN pos > 0 THEN loss_mask ELSE 0 END AS loss_mask,
                      CAST(pos > 0 AS INTEGER) AS is_valid FROM masked""",
        ),
        "t6_align_mask": _with(
            _ALL,
            """SELECT trajectory_id, CAST(count(*) AS INTEGER) AS n_tokens, repeat('1', count(*)) AS absent,
                      string_agg(loss_mask, '' ORDER BY pos) AS longer,
                      string_agg(CASE WHEN pos < 100 THEN loss_mask ELSE 0 END, '' ORDER BY pos) AS shorter
               FROM masked WHERE pos < 512 GROUP BY 1""",
        ),
        "t7_truncate": _with(
            _ALL,
            """SELECT trajectory_id, count(*) AS n_tokens, count(*) FILTER (WHERE pos > 0) AS n_scored,
                      CAST(sum((pos + 1) * CAST(token_id AS BIGINT)) AS BIGINT) AS id_sum
               FROM enc WHERE pos < 512 GROUP BY 1""",
        ),
        "t8_attention_mask": _with(
            _ALL, "SELECT trajectory_id, repeat('1', least(n_tokens, 8192)) AS mask FROM btok"
        ),
        "t9_prompt_window": _prompt("prompt_boundary"),
        "t10_prompt_first_n": _prompt("64"),
        "k1_top_k": _with(
            _DENSE,
            """SELECT trajectory_id, pos, string_agg(id, ',' ORDER BY rank) AS top_ids, round(sum(z), 6) AS val_sum
               FROM top GROUP BY vec_id, 1, 2""",
        ),
        "k1_top_k_rows": _with(
            _DENSE, "SELECT trajectory_id, pos, rank, CAST(id AS INTEGER) AS token_id, round(z, 6) AS score FROM top"
        ),
        "k2_top_k_map": _with(
            {**_DENSE, "lse1": "SELECT vec_id, ln(sum(exp(z))) AS lse FROM tz GROUP BY 1"},
            """SELECT trajectory_id, pos, CASE WHEN pos > 0 THEN string_agg(id, ',' ORDER BY rank) END AS top_ids,
                      CASE WHEN pos > 0 THEN round(sum(CAST(CAST(z - lse AS FLOAT) AS DOUBLE)), 4) END AS val_sum,
                      CAST(pos > 0 AS INTEGER) AS is_valid, CASE WHEN pos > 0 THEN any_value(loss_mask) ELSE 0 END AS loss_mask
               FROM top JOIN lse1 USING (vec_id) GROUP BY vec_id, trajectory_id, pos""",
        ),
        "k3_batch_scoring": _with(
            _ECHO,
            """SELECT e.trajectory_id, CAST(b.n_tokens AS INTEGER) AS seq_len, CAST(b.prompt_boundary AS INTEGER) AS prompt_boundary,
                      e.pos, e.token_id, CASE WHEN e.pos > 0 THEN e.loss_mask ELSE 0 END AS loss_mask, p.top_ids,
                      round(p.val_sum, 4) AS val_sum
               FROM enc e JOIN btok b USING (trajectory_id) LEFT JOIN echopos p USING (trajectory_id, pos)""",
        ),
        "k5_score_format": _with(
            _DENSE,
            """SELECT trajectory_id, pos, CASE WHEN loss_mask = 0 THEN 'logprobs' WHEN pos % 2 = 0 THEN 'logits' ELSE 'other' END AS format
               FROM vec""",
        ),
        "k6_teacher_distribution": _with(
            {
                **_DENSE,
                "tagged": """
                    SELECT *, CASE WHEN loss_mask = 0 THEN 'logprobs' WHEN pos % 2 = 0 THEN 'logits' ELSE 'other' END AS format
                    FROM top""",
                "weighed": "SELECT *, CASE WHEN format = 'logits' THEN exp(z / 2) ELSE exp(z) END AS w FROM tagged",
                "shared": "SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM weighed",
            },
            """SELECT trajectory_id, pos, format, round(max(CASE WHEN rank = 1 THEN p END), 6) AS p_first,
                      round(max(CASE WHEN rank = 8 THEN p END), 6) AS p_last, round(sum(p), 6) AS p_sum
               FROM shared GROUP BY 1, 2, 3""",
        ),
        "k7_student_log_softmax": _with(
            _DENSE,
            """SELECT v.trajectory_id, v.pos, round(any_value(l.lse), 6) AS lse,
                      round(max(CASE WHEN s.id = 0 THEN s.z / 2 END) - any_value(l.lse), 6) AS logp_first,
                      round(max(s.z / 2) - any_value(l.lse), 6) AS logp_max
               FROM sz s JOIN slse l USING (vec_id) JOIN vec v USING (vec_id) GROUP BY 1, 2""",
        ),
        "k8_gather_student": _with(
            _COUNTS,
            """SELECT e.trajectory_id, e.pos, t.n_scores, 0 AS n_missing, t.logp_sum
               FROM enc e LEFT JOIN (SELECT trajectory_id, pos, CAST(count(*) AS INTEGER) AS n_scores, round(sum(logq), 6) AS logp_sum
                                     FROM teacher GROUP BY 1, 2) t USING (trajectory_id, pos)""",
        ),
        "k9_position_kl": _with(_DENSE, "SELECT trajectory_id, pos, round(kl, 6) AS kl FROM dkl"),
        "k10_masked_mean": _with(_DENSE, f"SELECT {_MEAN} FROM dkl"),
        "k11_chunked_mean": _with(
            _COUNTS,
            """SELECT s.trajectory_id, ceil(b.n_tokens / 1024)::BIGINT AS n_chunks, s.n_masked,
                      round(s.kl_sum / (s.n_masked + 1e-8), 6) AS loss
               FROM sums s JOIN btok b USING (trajectory_id)""",
        ),
        "k12_dense_teacher_loss": _with(_DENSE, f"SELECT trajectory_id, {_MEAN} FROM dkl GROUP BY 1"),
        "k13_sample_kl": _with(
            _COUNTS, "SELECT trajectory_id, n_masked, round(kl_sum / (n_masked + 1e-8), 6) AS loss FROM sums"
        ),
        "k14_batch_kl": _with(
            _COUNTS,
            """SELECT batch_id, CAST(sum(n_masked) AS BIGINT) AS n_masked, round(sum(kl_sum) / (sum(n_masked) + 1e-8), 6) AS loss
               FROM batched GROUP BY 1""",
        ),
        "k15_mean_of_samples": _with(
            _COUNTS,
            """SELECT batch_id, count(*) AS n_samples, round(avg(kl_sum / (n_masked + 1e-8)) / 4, 6) AS loss
               FROM batched GROUP BY 1""",
        ),
        "k16_mask_choice": _with(
            {
                **_DENSE,
                "chosen": "SELECT trajectory_id, kl, CASE WHEN best_id % 2 = 0 THEN loss_mask ELSE 1 END AS loss_mask FROM dkl",
            },
            f"SELECT trajectory_id, {_MEAN} FROM chosen GROUP BY 1",
        ),
        "k17_evaluation_mean": _with(
            _COUNTS,
            """SELECT round(avg(loss), 6) AS avg_loss, count(*) AS n_batches
               FROM (SELECT sum(kl_sum) / (sum(n_masked) + 1e-8) AS loss FROM batched GROUP BY batch_id)""",
        ),
        "b1_split": _with(
            {**_HEADERS, "ordered": f"SELECT trajectory_id, {_hash_order('hdr', '42')}"},
            """SELECT trajectory_id, CASE WHEN idx < greatest(1, floor((SELECT count(*) FROM hdr) * 0.05::DOUBLE))
                                          THEN 'val' ELSE 'train' END AS split FROM ordered""",
        ),
        "b1_split_overlap": _with(
            {
                **_DOCS,
                "golddoc": f"SELECT DISTINCT trajectory_id, repo FROM docmsg WHERE {_GOLDDOC}",
                "ordered": f"SELECT trajectory_id, repo, {_hash_order('golddoc', '42')}",
                "sides": """
                    SELECT repo, idx < greatest(1, floor((SELECT count(*) FROM golddoc) * 0.05::DOUBLE)) AS held_out
                    FROM ordered""",
            },
            """SELECT count(*) AS n_values, count(*) FILTER (WHERE n = 2) AS n_shared
               FROM (SELECT repo, count(DISTINCT held_out) AS n FROM sides GROUP BY 1)""",
        ),
        "b2_sample_index": _with(
            _HEADERS,
            "SELECT trajectory_id, CAST(row_number() OVER (ORDER BY trajectory_id) - 1 AS BIGINT) AS idx FROM hdr",
        ),
        "b3_shuffle": _with(
            _HEADERS,
            f"""SELECT trajectory_id, 0 AS epoch, {_hash_order('hdr', '42:0')}
                UNION ALL SELECT trajectory_id, 1, {_hash_order('hdr', '42:1')}""",
        ),
        "b4_assign_batches": _with(
            {**_HEADERS, "ordered": f"SELECT trajectory_id, {_hash_order('hdr', '42:0')}"},
            "SELECT trajectory_id, idx, idx // 8 AS batch_id, CAST(idx % 8 AS INTEGER) AS slot FROM ordered",
        ),
        "b5_pad_batch": _with(
            {
                **_ALL,
                "shuffled": _COUNTS["shuffled"],
                "arrays": """
                    SELECT trajectory_id, list(token_id ORDER BY pos) AS ids, list(loss_mask ORDER BY pos) AS ms
                    FROM enc GROUP BY 1""",
                "batches": """
                    SELECT a.*, o.idx // 8 AS batch_id, CAST(o.idx % 8 AS INTEGER) AS slot,
                           least(1024, max(len(ids)) OVER (PARTITION BY o.idx // 8)) AS n
                    FROM arrays a JOIN shuffled o USING (trajectory_id)""",
            },
            """SELECT trajectory_id, batch_id, slot, CAST(n AS INTEGER) AS batch_max_len,
                      array_to_string(list_transform(range(n), lambda i: coalesce(ids[i + 1], -1)), ',') AS input_ids,
                      array_to_string(list_transform(range(n), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), '') AS attention_mask,
                      array_to_string(list_transform(range(n), lambda i: coalesce(ms[i + 1], 0)), '') AS loss_mask
               FROM batches""",
        ),
        "b6_pad_scores": _with(
            _DENSE,
            """SELECT trajectory_id, s.n_scored, 50 AS n_rows,
                      round(sum(CASE WHEN pos < s.n_scored THEN z ELSE 0 END), 4) AS val_sum,
                      string_agg(CASE WHEN pos < s.n_scored THEN id ELSE 0 END, ',' ORDER BY pos, rank) AS indices
               FROM top2 JOIN scored s USING (trajectory_id) GROUP BY 1, 2""",
        ),
        "b6_batch_length": _with(
            {
                **_DENSE,
                "placed": """
                    SELECT trajectory_id, n_scored,
                           CAST((row_number() OVER (ORDER BY md5('42:0:' || trajectory_id)) - 1) // 3 AS BIGINT) AS batch_id
                    FROM scored""",
                "sized": "SELECT *, max(n_scored) OVER (PARTITION BY batch_id) AS len FROM placed",
            },
            """SELECT trajectory_id, s.batch_id, s.len AS batch_max_len, s.len AS n_ids, s.len AS n_rows,
                      round(sum(CASE WHEN pos < s.n_scored THEN z ELSE 0 END), 4) AS val_sum,
                      string_agg(CASE WHEN pos < s.n_scored THEN id ELSE 0 END, ',' ORDER BY pos, rank) AS indices
               FROM top2 JOIN sized s USING (trajectory_id) WHERE pos < s.len GROUP BY ALL""",
        ),
        "b7_batch_metadata": _with(
            {
                **_DENSE,
                "tagged": """
                    SELECT trajectory_id, coalesce(CASE WHEN n_scored < 44 THEN 'logits' WHEN n_scored % 2 = 0 THEN 'logprobs' END, 'logprobs') AS format,
                           CAST((row_number() OVER (ORDER BY md5('42:0:' || trajectory_id)) - 1) // 3 AS BIGINT) AS batch_id
                    FROM scored""",
            },
            """SELECT batch_id, min(format) AS format, 2 AS top_k, true AS has_loss_mask, min(format) = max(format) AS is_uniform
               FROM tagged GROUP BY 1""",
        ),
        "a1_message_profile": _with(
            _HEADERS,
            """SELECT min(n_messages) AS min_messages, max(n_messages) AS max_messages, round(avg(n_messages), 6) AS avg_messages
               FROM gold""",
        ),
        "a2_funnel": _with(
            _ALL,
            """SELECT count(*) AS n_total,
                      count(*) FILTER (WHERE resolved = 1 AND exit_status = 'submit') AS n_gold,
                      count(*) FILTER (WHERE resolved = 1 AND exit_status = 'submit' AND n_tokens >= 1000) AS n_processed
               FROM hdr LEFT JOIN btok USING (trajectory_id)""",
        ),
        "a3_running_loss": _with(
            _STEPS,
            """SELECT run_id, epoch, step, loss, round(avg_loss, 6) AS avg_loss
               FROM (SELECT *, avg(loss) OVER (PARTITION BY run_id, epoch ORDER BY step
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS avg_loss FROM steps)
               WHERE (step + 1) % 5 = 0""",
        ),
        "a4_new_best": _with(
            _STEPS,
            """SELECT run_id, epoch, val_loss,
                      val_loss < coalesce(min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS is_best
               FROM epochs""",
        ),
        "a4_exact_best": _with(
            {
                **_STEPS,
                "sums": """SELECT run_id, epoch, CAST(sum(CAST(loss AS DECIMAL(28,18))) AS DOUBLE) / count(*) AS val_loss
                           FROM steps GROUP BY 1, 2""",
            },
            """SELECT run_id, epoch, round(val_loss, 6) AS val_loss,
                      val_loss < coalesce(min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS is_best
               FROM sums""",
        ),
        "a5_every_nth_epoch": _with(_STEPS, "SELECT run_id, epoch, val_loss FROM epochs WHERE (epoch + 1) % 2 = 0"),
        "prepare_gold_set": _with(
            {**_DOCS, "g": f"{doc_headers} WHERE {_GOLDDOC} GROUP BY ALL"},
            """SELECT CAST(min(n_messages) AS BIGINT) AS min_messages, CAST(max(n_messages) AS BIGINT) AS max_messages,
                      round(avg(n_messages), 6) AS avg_messages FROM g""",
        ),
        "build_score_cache": _with(
            _ECHO,
            """SELECT e.trajectory_id, count(*) AS n_tokens,
                      CAST(sum(CASE WHEN e.pos > 0 THEN e.loss_mask ELSE 0 END) AS BIGINT) AS n_masked,
                      CAST(count(p.top_ids) AS BIGINT) AS n_valid, CAST(sum(p.best_id) AS BIGINT) AS best_id_sum,
                      round(sum(p.val_sum), 4) AS val_sum
               FROM enc e LEFT JOIN echopos p USING (trajectory_id, pos) GROUP BY 1""",
        ),
        "build_cache_user_tokenizer": _with(
            {
                **{k: v for k, v in _ALL.items() if k not in ("dict", "enc", "masked", "tok", "tok0", "toks", "btok")},
                "w0": f"""
                    SELECT trajectory_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos
                    FROM (SELECT trajectory_id, regexp_extract_all(text, '{_WORD}') AS ws FROM txt WHERE length(text) >= 100)""",
                "w": """
                    SELECT *, length(w) AS token_id, coalesce(sum(length(w)) OVER (PARTITION BY trajectory_id ORDER BY pos
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w0""",
                "enc": """
                    SELECT w.*, b.b, CAST(EXISTS (SELECT 1 FROM located a WHERE a.trajectory_id = w.trajectory_id
                           AND a.role = 'assistant' AND w.s < a.char_end AND w.s + length(w.w) > a.char_start) AS INTEGER) AS loss_mask
                    FROM w JOIN bound b USING (trajectory_id)""",
                **{k: _ECHO[k] for k in ("echo", "echo2", "echopos")},
            },
            """SELECT e.trajectory_id, count(*) AS n_tokens,
                      CAST(sum(CASE WHEN e.pos > 0 THEN e.loss_mask ELSE 0 END) AS BIGINT) AS n_masked,
                      CAST(count(p.top_ids) AS BIGINT) AS n_valid, CAST(sum(p.best_id) AS BIGINT) AS best_id_sum,
                      round(sum(p.val_sum), 4) AS val_sum,
                      CAST(coalesce(min(CASE WHEN e.s >= e.b THEN e.pos END), count(*)) AS INTEGER) AS prompt_boundary
               FROM enc e LEFT JOIN echopos p USING (trajectory_id, pos) GROUP BY 1""",
        ),
        "training_batches": _with(
            {
                **_COUNTS,
                **_sides("0"),
                "arrays": """
                    SELECT trajectory_id, list(token_id ORDER BY pos) AS ids,
                           list(CASE WHEN pos > 0 THEN loss_mask ELSE 0 END ORDER BY pos) AS ms
                    FROM enc WHERE pos < 512 GROUP BY 1""",
                "vals": """
                    SELECT trajectory_id, sum(CAST(CAST(val AS FLOAT) AS DOUBLE)) AS val_sum
                    FROM teacher WHERE pos < 512 GROUP BY 1""",
                "slotted": """
                    SELECT a.*, o.split, o.batch_id, o.slot, max(len(ids)) OVER (PARTITION BY o.split, o.batch_id) AS n
                    FROM arrays a JOIN numbered o USING (trajectory_id)""",
            },
            """SELECT p.trajectory_id, p.split, p.batch_id, p.slot, CAST(n AS INTEGER) AS batch_max_len,
                      CAST(len(ids) AS INTEGER) AS n_tokens,
                      array_to_string(list_transform(range(n), lambda i: coalesce(ids[i + 1], -1)), ',') AS input_ids,
                      array_to_string(list_transform(range(n), lambda i: coalesce(ms[i + 1], 0)), '') AS loss_mask,
                      array_to_string(list_transform(range(64), lambda i:
                          CASE WHEN i < least(b.prompt_boundary, 64, len(ids)) THEN ids[i + 1] ELSE -1 END), ',') AS prompt_ids,
                      CAST(n AS INTEGER) AS n_rows, CAST(n * 8 AS INTEGER) AS n_scores, round(coalesce(val_sum, 0), 3) AS val_sum
               FROM slotted p JOIN btok b USING (trajectory_id) LEFT JOIN vals USING (trajectory_id)""",
        ),
        "evaluate_epoch": " UNION ALL ".join(
            "SELECT * FROM ("
            + _with(
                {
                    **_COUNTS,
                    **_sides(epoch),
                    "losses": """
                        SELECT split, n.batch_id, sum(kl_sum) / (sum(n_masked) + 1e-8) AS loss
                        FROM sums JOIN numbered n USING (trajectory_id) GROUP BY 1, 2""",
                },
                f"SELECT split, {epoch} AS epoch, round(avg(loss), 6) AS avg_loss, count(*) AS n_batches FROM losses GROUP BY 1",
            )
            + ")"
            for epoch in ("0", "1")
        ),
    }
    found["m2_native_arguments"] = found["m2_normalise_arguments"]
    # The store keeps scores in single precision, and so do its losses.
    single = ("b.rank, b.val, b.token_id", "b.rank, CAST(CAST(b.val AS FLOAT) AS DOUBLE) AS val, b.token_id")
    found["k14_clustered"] = found["k14_batch_kl"].replace(*single)
    found["evaluate_clustered"] = found["evaluate_epoch"].replace(*single)
    found["s11_store_summary"] = _with(
        _HEADERS,
        "SELECT count(*) AS n_trajectories, count(*) AS n_without_mask, true AS all_files, true AS all_bytes FROM hdr",
    )
    once = """count(*) AS n_{0}, CAST(sum((pos + 1) * CAST(token_id AS BIGINT)) AS BIGINT) AS id_sum_{0},
              round(sum(coalesce(val, 0)), 3) AS val_sum_{0}"""
    found["s6_compacted_cache"] = _with(
        {
            **_COUNTS,
            "vals": """
                SELECT trajectory_id, pos, sum(CAST(CAST(val AS FLOAT) AS DOUBLE)) AS val FROM teacher GROUP BY 1, 2""",
        },
        f"""SELECT trajectory_id, {once.format('before')}, {once.format('after')}, CAST(max(pos) + 1 AS INTEGER) AS seq_len,
                   CASE WHEN CAST(trajectory_id AS BIGINT) % 3 = 0 THEN 'first' ELSE 'second' END AS run_id
            FROM enc LEFT JOIN vals USING (trajectory_id, pos) GROUP BY 1""",
    )
    found["k1_top_k_partial"] = found["k1_top_k"]
    found["k12_partial_selection"] = found["k12_dense_teacher_loss"]
    found["k3_balanced_scoring"] = _with(
        {**_ALL, **{k: v for k, v in _ECHO.items() if k.startswith("echo")}},
        """SELECT e.trajectory_id, CAST(least(b.n_tokens, 8192) AS INTEGER) AS seq_len,
                  CAST(least(b.prompt_boundary, 8192) AS INTEGER) AS prompt_boundary,
                  e.pos, e.token_id, CASE WHEN e.pos > 0 THEN e.loss_mask ELSE 0 END AS loss_mask, p.top_ids,
                  round(p.val_sum, 4) AS val_sum, 'ok' AS status
           FROM enc e JOIN btok b USING (trajectory_id) LEFT JOIN echopos p USING (trajectory_id, pos)
           WHERE e.pos < 8192 AND (SELECT length(t.text) FROM txt t WHERE t.trajectory_id = e.trajectory_id) >= 100""",
    )
    found["s13_quarantine_sink"] = _with(
        _GOLD,
        """SELECT trajectory_id, CASE WHEN n_tokens <= 1200 THEN CAST(n_tokens AS INTEGER) END AS seq_len,
                  CASE WHEN n_tokens <= 1200 THEN 0 ELSE 2 END AS n_attempts,
                  CASE WHEN n_tokens > 1200 THEN 'ValueError: ' || n_tokens || ' tokens' END AS error,
                  CASE WHEN n_tokens > 1200 THEN 'second' END AS run_id
           FROM btok JOIN txt USING (trajectory_id) WHERE length(text) >= 100""",
    )
    found["k14_exact_sum"] = found["k14_batch_kl"]
    found["b5_chunked_batches"] = _with(
        {
            **_COUNTS,
            **_sides("0"),
            "lens": """
                SELECT b.trajectory_id, CAST(least(b.n_tokens, 2500) AS INTEGER) AS n, b.prompt_boundary, o.split, o.batch_id, o.slot,
                       CAST(max(least(b.n_tokens, 2500)) OVER (PARTITION BY o.split, o.batch_id) AS INTEGER) AS longest
                FROM btok b JOIN numbered o USING (trajectory_id)""",
            "cells": "SELECT *, CAST(unnest(range((longest + 1023) // 1024)) AS INTEGER) AS chunk FROM lens",
            "parts": """
                SELECT trajectory_id, CAST(pos // 1024 AS INTEGER) AS chunk, string_agg(token_id, ',' ORDER BY pos) AS input_ids,
                       string_agg(CASE WHEN pos > 0 THEN loss_mask ELSE 0 END, '' ORDER BY pos) AS loss_mask,
                       list(token_id ORDER BY pos) AS ids
                FROM enc WHERE pos < 2500 GROUP BY 1, 2""",
            "vals": """
                SELECT trajectory_id, CAST(pos // 1024 AS INTEGER) AS chunk, sum(CAST(CAST(val AS FLOAT) AS DOUBLE)) AS val_sum
                FROM teacher WHERE pos < 2500 GROUP BY 1, 2""",
            "sized": """
                SELECT *, greatest(least(n - chunk * 1024, 1024), 0) AS n_tokens, least(longest - chunk * 1024, 1024) AS width FROM cells""",
        },
        """SELECT trajectory_id, split, batch_id, slot, chunk, longest AS batch_max_len, n_tokens, width - n_tokens AS n_padding,
                  coalesce(input_ids, '') AS input_ids, coalesce(loss_mask, '') AS loss_mask,
                  CASE WHEN chunk = 0 THEN array_to_string(list_transform(range(64), lambda i:
                      CASE WHEN i < least(prompt_boundary, 64, n) THEN ids[i + 1] ELSE -1 END), ',') END AS prompt_ids,
                  n_tokens * 8 AS n_scores, round(coalesce(val_sum, 0), 3) AS val_sum
           FROM sized LEFT JOIN parts USING (trajectory_id, chunk) LEFT JOIN vals USING (trajectory_id, chunk)""",
    )
    found["s8_npz_files"] = found["s8_npz_import"]
    return found
