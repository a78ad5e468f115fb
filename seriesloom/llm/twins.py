"""SQL twins of the operators on shards, vector codes and conversations, for an engine without Spark's functions."""

from __future__ import annotations

from . import shard_map, turn_repair, vector_codes

#: The checksum's table is made from its polynomial: a step for each bit.
_CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)"


def _crc32(text: str) -> str:
    """CRC-32 of a text's bytes; needs crc_table among the tables."""
    data = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda a, x: xor(a >> 8, tab[CAST(xor(a & 255, x) AS INTEGER) + 1])), 4294967295)"


def shards(number: int = 8) -> str:
    def hexadecimal(text: str, at: int, n: int) -> str:
        return f"CAST('0x' || substr(md5({text}), {at}, {n}) AS HUGEINT)"

    def jumps(source: str, name: str, number: int) -> str:
        """A table for each step of all keys, the last one called name."""
        out = [f"{name}_0 AS (SELECT id, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, {hexadecimal('id', 1, 16)} AS k FROM {source})"]
        for step in range(number):
            key = f"(k * {shard_map.FACTOR} + 1) % 18446744073709551616"
            at = f"CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(({key}) // 8589934592 + 1 AS DOUBLE))) AS BIGINT)"
            out.append(f"{name}_{step + 1} AS MATERIALIZED (SELECT id, CASE WHEN j < {number} THEN j ELSE b END AS b, CASE WHEN j < {number} THEN {at} ELSE j END AS j, CASE WHEN j < {number} THEN {key} ELSE k END AS k FROM {name}_{step})")
        return ", ".join([*out, f"{name} AS (SELECT id, CAST(b AS INTEGER) AS s FROM {name}_{number})"])

    return (
        f"WITH {_CRC_TABLE}, rows AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc32(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS text_crc32 FROM documents, crc_table), "
        f"ids AS (SELECT DISTINCT id FROM rows), {jumps('ids', 'now', number)}, {jumps('ids', 'later', number + 1)}, "
        f"dealt AS (SELECT rows.*, now.s AS shard, later.s AS grown_shard, {hexadecimal(chr(99) + 'oncat_ws(' + chr(39) + ',' + chr(39) + ', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR), CAST(text_crc32 AS VARCHAR))', 1, 4)} % {shard_map.BUCKETS} AS bucket FROM rows JOIN now USING (id) JOIN later USING (id)) "
        "SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM dealt"
    )


def vector_code_rows() -> str:
    parts, entries, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    # a row for each part: r is the row, p the part, x its components
    cut = f"list_transform(embedding[1 + p * (len(embedding) // {parts}):(p + 1) * (len(embedding) // {parts})], lambda c: CAST(floor(CAST(c AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT))"
    out = [
        f"fine AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)",
        f"cut AS MATERIALIZED (SELECT r, p, {cut} AS x FROM fine, (SELECT unnest(range({parts})) AS p))",
        f"e0 AS (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= {entries})",
    ]

    def nearest(k: int) -> str:
        far = "list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
        return f"a{k} AS MATERIALIZED (SELECT r, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT r, cut.p, e, CAST({far} AS BIGINT) AS d FROM cut JOIN e{k} USING (p)) GROUP BY 1, 2)"

    for k in range(rounds):
        means = f"SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS m FROM (SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{k} JOIN cut USING (r, p), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2"
        out += [nearest(k), f"e{k + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m, c) AS c FROM e{k} o LEFT JOIN ({means}) n ON o.p = n.p AND o.e = n.e)"]
    out += [
        nearest(rounds),
        f"coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)",
        f"books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM e{rounds})",
    ]
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM fine JOIN coded USING (r), books"


def repaired_conversations() -> str:
    c, spaces = turn_repair, turn_repair.SPACES
    space = "coalesce(CAST({} AS VARCHAR), ' ')".format
    steps = " UNION ALL ".join(f"SELECT {q} AS q, {q2} AS q2, {n} AS k, {names} AS roles" for q, q2, n, names in [
        *[(q, q, 0, "CAST([] AS VARCHAR[])") for q in range(4)], *[(q, 2, 1, "['user:']") for q in (0, 1, 3)], *[(q, 3, 2, "['user:', 'assistant:']") for q in (0, 1)], (2, 3, 1, "['assistant:']"),
    ])
    moves = " UNION ALL ".join([f"SELECT {q} AS q, {q2} AS q2, '{role}' AS role" for role, pairs in (("s", [(0, 1)]), ("u", [(0, 2), (1, 2), (3, 2)]), ("a", [(2, 3)])) for q, q2 in pairs])
    return (
        f"WITH RECURSIVE {_CRC_TABLE}, given AS (SELECT conv_id, turn, {space('role')} AS role, {space('text')} AS text, {_crc32(space('conv_id') + chr(124) * 2 + repr(':') + chr(124) * 2 + space('turn'))} % 20 AS way FROM conversations, crc_table), "
        "harmed AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE WHEN way = 1 THEN '' WHEN way = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE way WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM given), "
        "placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM harmed), "
        f"judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{spaces}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' "
        f"WHEN regexp_extract(text, '([^{spaces}])[{spaces}]*\\z', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r0 FROM placed), "
        "counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, "
        "count(*) FILTER (i > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY 1), "
        f"steps AS ({steps}), moves AS ({moves}), "
        f"edits AS (SELECT q, q AS q2, 'D' AS edit, {c.DELETE} AS c, NULL AS role FROM (SELECT unnest(range(4)) AS q) UNION ALL SELECT q, q2, 'K', {c.KEEP}, role FROM moves UNION ALL SELECT q, q2, 'R', {c.REROLE}, role FROM moves WHERE role <> 's'), "
        "reached AS (SELECT conv_id, 0 AS i, 0 AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL "
        "SELECT conv_id, i, q, best.cost, best.audit, lines FROM (SELECT conv_id, i, q, min({'cost': cost, 'audit': audit}) AS best, arg_min(lines, {'cost': cost, 'audit': audit}) AS lines FROM ("
        f"SELECT s.conv_id, j.i, e.q2 AS q, s.cost + t.k * {c.INSERT} + e.c + CASE WHEN j.fault = 'truncated' AND e.edit <> 'D' THEN {c.TRUNCATED} ELSE 0 END AS cost, s.audit || repeat('I', t.k) || e.edit AS audit, "
        "s.lines || t.roles || CASE e.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [j.role || ':' || j.text] ELSE [CASE e.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text] END AS lines "
        "FROM reached s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = s.i + 1 JOIN steps t ON s.q = t.q JOIN edits e ON e.q = t.q2 "
        "WHERE e.edit = 'D' OR (j.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.role = j.r))) GROUP BY 1, 2, 3)), "
        f"ends AS (SELECT s.conv_id, min({{'cost': s.cost + t.k * {c.INSERT}, 'audit': s.audit || repeat('I', t.k)}}) AS best, arg_min(s.lines || t.roles, {{'cost': s.cost + t.k * {c.INSERT}, 'audit': s.audit || repeat('I', t.k)}}) AS lines "
        "FROM reached s LEFT JOIN counts n ON s.conv_id IS NOT DISTINCT FROM n.conv_id JOIN steps t ON s.q = t.q WHERE s.i = coalesce(n.n, 0) AND t.q2 IN (0, 3) GROUP BY 1) "
        "SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, "
        "sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM ends e LEFT JOIN counts n ON e.conv_id IS NOT DISTINCT FROM n.conv_id"
    )
