"""DuckDB SQL that is put together by rule: levels of a tree, and a checksum bit by bit."""

from __future__ import annotations

from tessera.llm.lexical_search import K, LOWER, TERM, UPPER


def lexical_search() -> str:
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents),
whole AS (SELECT count(*) FILTER (WHERE len(t) > 0)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), whole GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0) WHERE rank <= {K}
"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters."""
    step = "CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END"
    bits = f"list_transform(range(8 * length({text})), lambda k: CASE WHEN k % 8 = 0 THEN ascii(substr({text}, k // 8 + 1, 1)) ELSE 0 END::BIGINT)"
    return f"xor(list_reduce({bits}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _digest(text: str) -> str:
    part = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part.format(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, depth: int) -> list[str]:
    """Levels name0 .. (key, p, h, n) and the runs of each, as common tables."""
    out = []
    for i in range(depth):
        out.append(f"{name}r{i} AS (SELECT key, p // 16 AS run, n, list(h ORDER BY p) AS hs FROM {name}{i} GROUP BY ALL)")
        out.append(f"{name}{i + 1} AS (SELECT key, run AS p, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 15) // 16 AS n FROM {name}r{i})")
    return out


def _way(base: str, name: str, depth: int, key: str, place: str) -> list[str]:
    """Steps of every row of base up the tree: proof and folded grow, a common table for each level."""
    out, before = [], base
    for i in range(depth):
        at = f"({place} // {16**i}) % 16"
        left, right = (f"coalesce(array_to_string({x}, ''), '')" for x in (f"hs[1:{at}]", f"hs[{at} + 2:]"))
        out.append(
            f"{name}w{i} AS (SELECT b.* EXCLUDE (proof, folded), CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof, "
            f"CASE WHEN n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded "
            f"FROM {before} b JOIN {name}r{i} r ON {key} IS NOT DISTINCT FROM r.key AND {place} // {16 ** (i + 1)} = r.run)"
        )
        before = f"{name}w{i}"
    return out


def merkle_manifest(depth: int = 5, above: int = 3) -> str:
    """As many levels as 16^5 rows of a source and 16^3 sources take."""
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    hit = f"doc_id IS NOT NULL AND text IS NOT NULL AND {crc32('doc_id::VARCHAR')} % 5 = 0"
    parts = [
        f"l AS (SELECT doc_id, source, {_digest('text')} AS leaf, CASE WHEN {hit} THEN {_digest(lowered)} END AS changed FROM documents)",
        "a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS many, '' AS proof, coalesce(changed, leaf) AS folded FROM l)",
        "t0 AS (SELECT source AS key, place AS p, leaf AS h, many AS n FROM a)", *_tree("t", depth),
        f"s AS (SELECT key AS source, h AS subroot, row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS above FROM t{depth})",
        "u0 AS (SELECT 0 AS key, above AS p, subroot AS h, (SELECT count(*) FROM s) AS n FROM s)", *_tree("u", above), *_way("a", "t", depth, "b.source", "b.place"),
        f"c AS (SELECT x.*, s.subroot, s.above FROM t{'w' + str(depth - 1)} x JOIN s ON x.source IS NOT DISTINCT FROM s.source)", *_way("c", "u", above, "0", "b.above"),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, (SELECT h FROM u{above}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM u{above}) AS verified FROM uw{above - 1}"
