"""SQL for DuckDB that gives the same rows as a query, where SQL can express it."""

from __future__ import annotations

from transferwatch.llm.repair import DELETE, INSERT, RELABEL, TRUNCATION
from transferwatch.llm.vectorcodes import ENTRIES, PARTS, ROUNDS, SCALE


def vector_codes() -> str:
    """Lloyd's rounds as joins of components with the entries' components, a few subqueries each.

    The smallest of ``distance * entries + entry`` is the nearest entry, the lowest of equal ones.
    """
    ctes = [
        """kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, len(embedding) // {parts} AS width FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        """cells AS MATERIALIZED (
  SELECT vec_id, i // width AS p, i % width AS k,
         CAST(floor({scale} * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT *, unnest(range(len(embedding))) AS i FROM kept)
)""",
        """first AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}
)""",
        """book0 AS MATERIALIZED (SELECT p, e, k, x AS c FROM cells JOIN first USING (vec_id))""",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(
            f"""near{r} AS MATERIALIZED (
  SELECT vec_id, p, min(d * {{entries}} + e) AS best
  FROM (
    SELECT vec_id, p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d
    FROM cells JOIN book{r} USING (p, k) GROUP BY vec_id, p, e
  ) GROUP BY vec_id, p
)"""
        )
        if r < ROUNDS:
            ctes.append(
                f"""book{r + 1} AS MATERIALIZED (
  SELECT p, e, k, coalesce(m.c, b.c) AS c
  FROM book{r} b LEFT JOIN (
    SELECT p, best % {{entries}} AS e, k,
           CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c
    FROM cells JOIN near{r} USING (vec_id, p) GROUP BY p, best % {{entries}}, k
  ) m USING (p, e, k)
)"""
            )
    last = f"""coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % {{entries}}), '' ORDER BY p) AS code,
         CAST(sum(best // {{entries}}) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, k)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
    text = "WITH " + ",\n".join([*ctes, last])
    return text.format(parts=PARTS, scale=SCALE, entries=ENTRIES)


def conversation_repair() -> str:
    """Damage, faults, and the cheapest edits from each conversation's end to its start.

    A recursive query keeps, per conversation, the best end from each of the four grammar states as
    ``(cost, audit, lines)``, of which SQL takes the least.
    """
    def step(cost: str, label: str, line: str, state: str) -> str:
        """An edit put in front of the best end of a state; null where the state has none."""
        return (
            f"CASE WHEN {state} IS NOT NULL THEN {{{{'cost': {state}.cost + {cost}, 'audit': '{label}' || {state}.audit,"
            f" 'lines': {line} || {state}.lines}}}} END"
        )

    def least(*offers: str) -> str:
        return f"list_min(list_filter([{', '.join(offers)}], lambda o: o IS NOT NULL))"

    def ends(s0: str, s1: str, s2: str, s3: str, source: str) -> str:
        """The states with turns inserted, from a subquery that gives them without."""
        user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
        inserted = (
            f"SELECT * EXCLUDE (b0, b1, b2, b3), b0, b1, {least('b2', step(str(INSERT), 'I', assistant, 'b3'))} AS e2,"
            f" {least('b3', step(str(INSERT), 'I', user, 'b2'))} AS e3"
            f" FROM (SELECT *, {s0} AS b0, {s1} AS b1, {s2} AS b2, {s3} AS b3 FROM {source})"
        )
        return (
            f"SELECT conv_id, place, {least('b0', step(str(INSERT), 'I', user, 'e2'))} AS s0,"
            f" {least('b1', step(str(INSERT), 'I', user, 'e2'))} AS s1, e2 AS s2, e3 AS s3 FROM ({inserted})"
        )

    def edited(state: str, options: dict[str, str]) -> str:
        """The best end of a state in front of a row: delete it, or let it play a role that may come."""
        offers = [step(str(DELETE), "D", "''", state)]
        for role, after in options.items():
            kept = step("extra", "K", "chr(10) || role || ':' || text", after)
            offers.append(f"CASE WHEN stays AND initial = '{role}' THEN {kept} END")
            if role != "s":
                name = {"u": "user", "a": "assistant"}[role]
                changed = step(f"extra + {RELABEL}", "R", f"chr(10) || '{name}:' || text", after)
                offers.append(f"CASE WHEN stays AND initial <> '{role}' THEN {changed} END")
        return least(*offers)

    nothing = "{{'cost': 0, 'audit': '', 'lines': ''}}"
    none = f"CASE WHEN FALSE THEN {nothing} END"
    start = ends(nothing, none, none, nothing, "(SELECT conv_id, count(*) AS place FROM coded GROUP BY conv_id)")
    before = "(SELECT r.*, s0, s1, s2, s3 FROM best b JOIN coded r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.place = b.place - 1)"
    back = ends(
        edited("s0", {"s": "s1", "u": "s2"}), edited("s1", {"u": "s2"}), edited("s2", {"a": "s3"}),
        edited("s3", {"u": "s2"}),
        before,
    )
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)),"
        " lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0],"
        " lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"
    )
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    text = f"""WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
),
marked AS (SELECT *, {crc} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM marked WHERE kind <> 0)
),
placed AS (
  SELECT *, left(role, 1) AS initial, right(rtrim(text, {space}), 1) AS last,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            sha256(length(role) || ':' || role || text)) - 1 AS place
  FROM damaged
),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS again,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM placed
),
coded AS MATERIALIZED (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN again > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         last <> '' AND again = 1 AS stays,
         CASE WHEN last NOT IN ('.', '!', '?') THEN {TRUNCATION} ELSE 0 END AS extra
  FROM seen
),
best AS (
  {start}
  UNION ALL
  {back}
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (place > 0 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM coded GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(s0.cost, 0) AS BIGINT) AS cost, coalesce(s0.audit, '') AS audit,
       sha256(substr(coalesce(s0.lines, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.place = 0"""
    return text.replace("{{", "{").replace("}}", "}")


ORACLES: dict[str, str] = {
    "op11_conversation_repair": conversation_repair(),
    "op12_vector_codes": vector_codes(),
}
