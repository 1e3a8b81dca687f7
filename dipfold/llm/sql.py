"""SQL of operators that recursion and long expressions are needed for, put together from parts."""

from __future__ import annotations

#: A lower-casing of A-Z alone.
FOLD = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text."""
    hexed = f"hex(encode({text}))"
    octets = f"list_transform(range(0, length({hexed}) // 2), lambda i: CAST('0x' || substr({hexed}, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {byte}), 4294967295)"


def merkle(source_levels: int = 5, top_levels: int = 2) -> str:
    """A tree over each source and one over the sources; a level with one node left is handed on as it is."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    parts = [
        f"""d AS (SELECT doc_id, coalesce(source, '') AS s, source IS NOT NULL AS named, {leaf('text')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(f"({FOLD.format(text='text')})")} END AS changed FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY named, s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d FROM d)"""
    ]

    def level(name: str, k: int, key: str) -> str:
        run = f"PARTITION BY {key}, i // 16 ORDER BY i ROWS BETWEEN"
        return f"""{name}s{k} AS (SELECT {key}, i, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, count(*) OVER (PARTITION BY {key}) = 1 AS one FROM {name}{k}),
{name}{k + 1} AS (SELECT {key}, i // 16 AS i, CASE WHEN any_value(w) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
  FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS w FROM {name}{k}) GROUP BY {key}, i // 16)"""

    parts += [level("a", k, "named, s") for k in range(source_levels)]
    parts.append(f"b0 AS (SELECT 1 AS t, named, s, row_number() OVER (ORDER BY named, s) - 1 AS i, d FROM a{source_levels})")
    parts += [level("b", k, "t") for k in range(top_levels)]
    joined = "".join(f" JOIN as{k} ON as{k}.named = a0.named AND as{k}.s = a0.s AND as{k}.i = a0.i // {16**k}" for k in range(source_levels))
    joined += " JOIN b0 ON b0.named = a0.named AND b0.s = a0.s" + "".join(f" JOIN bs{k} ON bs{k}.i = b0.i // {16**k}" for k in range(top_levels))
    steps = [f"as{k}" for k in range(source_levels)] + [f"bs{k}" for k in range(top_levels)]
    sides = " || ".join(f"{t}.l || {t}.r" for t in steps)
    hold = ", ".join(f"{t}.l AS l{k}, {t}.r AS r{k}, {t}.one AS one{k}" for k, t in enumerate(steps))
    parts.append(f"f0 AS (SELECT a0.doc_id, a0.leaf, b0.d AS subroot, (SELECT d FROM b{top_levels}) AS root, sha256({sides}) AS proof_sha256, coalesce(a0.changed, a0.leaf) AS own, {hold} FROM a0{joined})")
    parts += [f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN one{k} THEN own ELSE sha256(l{k} || own || r{k}) END AS own) FROM f{k})" for k in range(len(steps))]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, own AS folded_root, own = root AS verified FROM f{len(steps)}"


def similar_shingles(measure) -> str:
    """Sets of shingles by the words, all pairs that share one counted, and components by reachability."""
    n = measure.shingle
    gram = " || ' ' || ".join(["w[i]", *(f"w[i + {k}]" for k in range(1, n))])
    return f"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({FOLD.format(text="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}) END) AS g FROM d),
z AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r JOIN z x ON x.r = a.r JOIN z y ON y.r = b.r
  GROUP BY a.r, b.r, x.n, y.n HAVING {measure.whole} * count(*) >= {measure.part} * (x.n + y.n - count(*))),
c AS (SELECT r, r AS q FROM d UNION SELECT c.r, p.b FROM c JOIN p ON p.a = c.q),
m AS (SELECT c.r, min(e.doc_id) AS component_id FROM c JOIN d e ON e.r = c.q GROUP BY c.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM d LEFT JOIN z USING (r) JOIN m USING (r)"""
