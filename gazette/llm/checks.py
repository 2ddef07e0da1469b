"""The results of some operators in DuckDB's SQL."""

from __future__ import annotations

from gazette.llm.merkle import ARITY, FIELDS, LOWER, UPPER
from gazette.llm.phrases import LEAST, LONGEST, TOP

# Levels the checks unroll: 8 ** 7 rows per language, 8 ** 3 languages.
TREE_LEVELS, TOP_LEVELS = 7, 3


def _leaf(fields: dict[str, str]) -> str:
    parts = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')"
             for f in fields.values()]
    return f"sha256({' || '.join(parts)})"


# CRC-32 of the decimal id: the start value, then per byte its value and eight shifts (-1).
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
  string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1,
  -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1
  THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""


def _levels(name: str, levels: int) -> list[str]:
    """``name0`` holds g, pos, n, h; every next one its parents, and ``name_s<k>`` the flanks."""
    out = []
    for k in range(levels):
        out.append(f"""{name}_s{k} AS (SELECT g, pos, n,
          coalesce(string_agg(h, '') OVER (PARTITION BY g, pos // {ARITY} ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
          coalesce(string_agg(h, '') OVER (PARTITION BY g, pos // {ARITY} ORDER BY pos
            ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k})""")
        out.append(f"""{name}{k + 1} AS (SELECT g, pos // {ARITY} AS pos,
          (n + {ARITY - 1}) // {ARITY} AS n, CASE WHEN n = 1 THEN min(h)
            ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
          FROM {name}{k} GROUP BY g, n, pos // {ARITY})""")
    return out


def merkle_sql() -> str:
    fields = dict(zip(FIELDS, FIELDS, strict=True))
    now = fields | {"text": f"translate(text, '{UPPER}', '{LOWER}')"}
    tables = [
        f"""leaves AS (SELECT doc_id, lang, {_leaf(fields)} AS leaf,
          CASE WHEN {CRC} % 3 = 0 THEN {_leaf(now)} ELSE {_leaf(fields)} END AS now
          FROM documents)""",
        "langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g "
        "FROM (SELECT DISTINCT lang FROM leaves))",
        """placed AS (SELECT doc_id, leaf, now, g,
          row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
          count(*) OVER (PARTITION BY g) AS n
          FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang)""",
        "a0 AS (SELECT g, pos, n, leaf AS h FROM placed)", *_levels("a", TREE_LEVELS),
        f"b0 AS (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, h FROM a{TREE_LEVELS})",
        *_levels("b", TOP_LEVELS)]
    source = "SELECT p.*, now AS node, '' AS proof FROM placed p"
    for name, levels, group, pos in (("a", TREE_LEVELS, "x.g", "x.pos"),
                                     ("b", TOP_LEVELS, "0", "x.g")):
        for k in range(levels):
            source = f"""SELECT x.* EXCLUDE (node, proof), proof || CASE WHEN s.n > 1
                THEN before || after ELSE '' END AS proof,
              CASE WHEN s.n > 1 THEN sha256(before || node || after) ELSE node END AS node
              FROM ({source}) x JOIN {name}_s{k} s ON s.g = {group}
                AND s.pos = {pos} // {ARITY ** k}"""
    return f"""WITH {", ".join(tables)}
      SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256,
        node AS folded_root, node = top.h AS verified
      FROM ({source}) x JOIN a{TREE_LEVELS} sub ON sub.g = x.g CROSS JOIN b{TOP_LEVELS} top"""


def phrases_sql() -> str:
    return f"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
      FROM documents),
    cut AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'),
      lambda x: x <> '') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
    starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
    grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM starts, range(1, {LONGEST + 1}) t(k) WHERE i + k - 1 <= len(w)
      GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
    kept AS (SELECT * FROM grams g WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM grams o
      WHERE o.lang = g.lang AND o.k > g.k AND 100 * o.f >= 100 * g.f
        AND contains(' ' || o.phrase || ' ', ' ' || g.phrase || ' '))),
    cuts AS (SELECT lang, phrase, f AS a, c,
        array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head,
        array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS rest
      FROM kept, range(1, {LONGEST}) t(c) WHERE c < k),
    scored AS (SELECT lang, cuts.phrase, a, c, h.f AS l, r.f AS r, n,
        (1000::HUGEINT * a * n // (h.f::HUGEINT * r.f))::BIGINT AS score
      FROM cuts JOIN grams h USING (lang) JOIN grams r USING (lang) JOIN totals USING (lang)
      WHERE h.phrase = head AND r.phrase = rest),
    best AS (SELECT * FROM scored QUALIFY
      row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
      phrase, a, l, r, n, score FROM best QUALIFY rank <= {TOP}"""
