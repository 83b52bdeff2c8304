"""DuckDB SQL that gives the same rows as the queries of this subpackage."""

from __future__ import annotations

from .shard_tree import DIGITS, RUN, Tree, leaves_in_order, levels

#: CRC-32 of a text's bytes, by a table of 256 steps that the polynomial makes.
CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || range(8)::BIGINT[],
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) AS r(i)))"""


def crc32(text: str) -> str:
    """Beside the one row of ``crc``: a lambda may use its column t, but no subquery."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = "xor(a >> 8, t[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda a, b: {step}), 4294967295)"


def _descent(name: str, tree: Tree) -> str:
    """(doc, spot): the number of the leaf that each row of ``docs`` comes to."""
    parts, above = [], "SELECT doc, k, 0 AS spot FROM docs"
    for depth, level in enumerate(levels(tree)):
        rows = ", ".join(f"({up}, {i}, '{label}', {weight!r}::DOUBLE)" for up, own in enumerate(level) for i, label, weight in own)
        parts.append(
            f"""{name}{depth} AS (
  SELECT doc, k, arg_min(i, -ln((('0x' || substr(md5(k || label), 1, {DIGITS}))::BIGINT + 0.5::DOUBLE) / {float(16**DIGITS)!r}::DOUBLE) / w) AS spot
  FROM ({above}) JOIN (VALUES {rows}) AS node(up, i, label, w) ON up = spot GROUP BY doc, k)"""
        )
        above = f"SELECT doc, k, spot FROM {name}{depth}"
    return ",\n".join(parts)


def shard_sql(tree: Tree, grown: Tree) -> str:
    def leaves(tree: Tree) -> str:
        return ", ".join(f"({i}, '{x.region}', '{x.rack}', {x.shard})" for i, x in enumerate(leaves_in_order(tree)))

    key = "coalesce(doc_id::VARCHAR, 'null')"
    columns = "doc_id, size, text_crc32, region, rack, shard, grown_shard"
    text = " || ':' || ".join(f"coalesce({c.strip()}::VARCHAR, 'null')" for c in columns.split(","))
    return f"""WITH {CRC_TABLE},
docs AS (
  SELECT row_number() OVER () AS doc, doc_id, {key} AS k, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
         {crc32("coalesce(text, '')")} AS text_crc32
  FROM documents CROSS JOIN crc),
{_descent("now", tree)},
{_descent("later", grown)},
placed AS (
  SELECT doc_id, size, text_crc32, a.region, a.rack, a.shard, b.shard AS grown_shard
  FROM docs JOIN now2 USING (doc) JOIN later2 USING (doc)
  JOIN (VALUES {leaves(tree)}) AS a(spot, region, rack, shard) ON a.spot = now2.spot
  JOIN (VALUES {leaves(grown)}) AS b(spot, region, rack, shard) ON b.spot = later2.spot),
runs AS (
  SELECT *, (row_number() OVER (PARTITION BY {columns}) - 1) // {RUN} AS run FROM placed)
SELECT {columns}, 'key' AS law,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5({text} || ':' || run::VARCHAR), 1, {DIGITS}), {columns}) - 1 AS slot
FROM runs"""


def _leaf(fields: tuple[str, ...]) -> str:
    parts = (f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields)
    return f"sha256({' || '.join(parts)})"


def _climb(name: str, start: str, group: str, fan: int) -> str:
    """(grp, h, idx, digest, n): the nodes of all levels, n of them on the level; from (grp, idx, digest)."""
    return f"""{name} AS (
  SELECT {group} AS grp, 0 AS h, idx, digest, count(*) OVER (PARTITION BY {group}) AS n FROM {start}
  UNION ALL
  SELECT grp, h + 1, idx // {fan}, sha256(string_agg(digest, '' ORDER BY idx)), (n + {fan - 1}) // {fan}
  FROM {name} WHERE n > 1 GROUP BY grp, h, idx // {fan}, n)"""


def _walk(name: str, nodes: str, start: str, fan: int) -> str:
    """(leaf, grp, h, idx, cur, proof): each leaf on its way up, cur folded from what it is now."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT w.leaf, w.grp, w.h + 1, w.idx // {fan},
         sha256(string_agg(CASE WHEN u.idx = w.idx THEN w.cur ELSE u.digest END, '' ORDER BY u.idx)),
         w.proof || coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx <> w.idx), '')
  FROM {name} AS w JOIN {nodes} AS u ON u.grp = w.grp AND u.h = w.h AND u.idx // {fan} = w.idx // {fan} AND u.n > 1
  GROUP BY w.leaf, w.grp, w.h, w.idx, w.cur, w.proof)"""


def merkle_sql(fields: tuple[str, ...], fan: int) -> str:
    lower = tuple("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if f == "text" else f for f in fields)
    return f"""WITH RECURSIVE {CRC_TABLE},
digests AS (
  SELECT doc_id, coalesce('1' || source, '0') AS grp, {_leaf(fields)} AS digest,
         CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(lower)} END AS changed
  FROM documents CROSS JOIN crc),
leaves AS (
  SELECT *, row_number() OVER () AS leaf, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM digests),
{_climb("up", "leaves", "grp", fan)},
subroots AS (SELECT grp AS name, digest, h AS height, row_number() OVER (ORDER BY grp) - 1 AS idx FROM up WHERE n = 1),
{_climb("high", "subroots", "0", fan)},
{_walk("walk", "up", "SELECT leaf, grp, 0 AS h, idx, coalesce(changed, digest) AS cur, '' AS proof FROM leaves", fan)},
arrived AS (
  SELECT w.leaf, w.grp, w.cur, w.proof, s.digest AS subroot, s.idx FROM walk AS w JOIN subroots AS s ON s.name = w.grp AND s.height = w.h),
{_walk("last", "high", "SELECT leaf, 0 AS grp, 0 AS h, idx, cur, proof FROM arrived", fan)}
SELECT l.doc_id, l.digest AS leaf, a.subroot, r.digest AS root, sha256(t.proof) AS proof_sha256, t.cur AS folded_root, t.cur = r.digest AS verified
FROM leaves AS l JOIN arrived AS a USING (leaf) JOIN (SELECT * FROM high WHERE n = 1) AS r ON true JOIN last AS t ON t.leaf = l.leaf AND t.h = r.h"""
