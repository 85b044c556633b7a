"""SQL of the operators that SQL can express, over the same Parquet tables."""

from __future__ import annotations

# --- op12: k-means in integers, one pair of common tables per round -----------------------------

_KEPT = """kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64)"""
_SEEDS = """c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (
        SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT 8))"""
_ASSIGN = """a{n} AS MATERIALIZED (
    SELECT r, min(struct_pack(d := d, k := k)) AS best FROM (
        SELECT r, c.k, CAST(list_sum(list_transform(range(1, 65), lambda j: (kept.v[j] - c.v[j]) * (kept.v[j] - c.v[j]))) AS BIGINT) AS d
        FROM kept, c{n} c) GROUP BY r)"""
_MOVE = """c{m} AS MATERIALIZED (
    SELECT c.k, coalesce(s.v, c.v) AS v FROM c{n} c LEFT JOIN (
        SELECT k, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM (
            SELECT best.k AS k, j, sum(kept.v[j]) AS t, count(*) AS n
            FROM a{n} JOIN kept USING (r), range(1, 65) g(j) GROUP BY 1, 2) GROUP BY k) s ON s.k = c.k)"""
CENTROIDS = (
    "WITH "
    + ",\n".join([_KEPT, _SEEDS, *(part.format(n=n, m=n + 1) for n in range(10) for part in (_ASSIGN, _MOVE)), _ASSIGN.format(n=10)])
    + """
SELECT vec_id, CAST(best.k AS INTEGER) AS "cluster", best.d AS distance,
    CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a10 JOIN kept USING (r) JOIN c10 c ON c.k = best.k"""
)

# --- op13: damage, faults, and the edits as a table of best paths per row ------------------------

_CRC = """crc AS MATERIALIZED (
    SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
    FROM range(0, 256) g(b))"""
_DAMAGE = r"""hashed AS (
    SELECT c.*, xor(list_reduce(
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda s: CAST(ascii(s) AS BIGINT)),
        lambda h, b: xor(h >> 8, crc.t[1 + (xor(h, b) & 255)]), 4294967295), 4294967295) % 20 AS damage
    FROM conversations c, crc),
damaged AS (
    SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
        CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
        unnest(CASE WHEN damage = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM hashed WHERE damage <> 0),
numbered AS (
    SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
        rtrim(text, E' \t\n\x0b\f\r') AS body
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
judged AS MATERIALIZED (
    SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, i, role, text, left(role, 1) AS k, pair,
        CASE WHEN body = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM numbered)"""


def _best(*options: str) -> str:
    """The least of paths {cost, audit, lines}, NULL being no path."""
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"


def _go(state: str, cost: str, letter: str, line: str | None, when: str = "true") -> str:
    """The path to ``state`` with one more edit; NULL where there is no such path."""
    lines = f"list_append({state}.x, {line})" if line else f"{state}.x"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', x := {lines}) END"


def _step() -> str:
    """Paths to the four states after a row, then after an insertion, and after a second one."""
    keep, late = "j.fault NOT IN ('blank', 'duplicate')", "CASE j.fault WHEN 'truncated' THEN 5 ELSE 0 END"
    own, user, assistant = "(j.role || ':' || j.text)", "('user:' || j.text)", "('assistant:' || j.text)"
    delete = {s: _go(f"p.{s}", "2", "D", None) for s in "bsuv"}

    def onto(sources: str, initial: str, line: str | None) -> list[str]:
        kept = [_go(f"p.{s}", late, "K", own, f"{keep} AND j.k = '{initial}'") for s in sources]
        return kept + ([_go(f"p.{s}", f"1 + {late}", "R", line, keep) for s in sources] if line else [])

    return f"""SELECT j.c, j.i, {delete["b"]} AS b, {_best(delete["s"], *onto("b", "s", None))} AS s,
        {_best(delete["u"], *onto("bsv", "u", user))} AS u, {_best(delete["v"], *onto("u", "a", assistant))} AS v
    FROM path p JOIN judged j ON j.c = p.c AND j.i = p.i + 1"""


def _inserted(table: str) -> str:
    user, assistant = "'user:'", "'assistant:'"
    first = f"""SELECT c, i, b, s, {_best("u", _go("b", "5", "I", user), _go("s", "5", "I", user), _go("v", "5", "I", user))} AS u,
        {_best("v", _go("u", "5", "I", assistant))} AS v FROM ({table})"""
    return f"""SELECT c, i, b, s, {_best("u", _go("v", "5", "I", user))} AS u, {_best("v", _go("u", "5", "I", assistant))} AS v FROM ({first})"""


_NONE = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, x VARCHAR[]))"
_START = f"""SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, struct_pack(c := CAST(0 AS BIGINT), a := '', x := CAST([] AS VARCHAR[])) AS b,
        {_NONE} AS s, {_NONE} AS u, {_NONE} AS v FROM judged"""
_PATHS = f"path AS (\n    {_inserted(_START)}\n    UNION ALL\n    {_inserted(_step())})"
REPAIR = f"""WITH RECURSIVE {_CRC},
{_DAMAGE},
{_PATHS},
ends AS (
    SELECT c, {_best("b", "v")} AS e FROM path WHERE (c, i) IN (SELECT (c, max(i)) FROM judged GROUP BY c)),
counts AS (
    SELECT c, conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY c, conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit,
    sha256(coalesce(array_to_string(e.x, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends USING (c)"""

SQL = {"op12_centroid_clustering": CENTROIDS, "op13_conversation_repair": REPAIR}
