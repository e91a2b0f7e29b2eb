"""A Merkle manifest of a dataset: a tree a source, a tree of their roots, and a recursive query that climbs from every leaf.

A row is a leaf; leaves of a source ascend by number, and every 16 nodes in a row become one node of the level above, up to the
source's subroot; the subroots become the root in the same way. The levels are built one by one and stored as parent-linked
rows: a node's row holds its parent's name and digest and its siblings before and after it. A recursive query then ascends. The
leaves of one run of 16 go together in a row, for all they meet above their run is the same, while each leaf is folded by itself:
a step joins the rows to their node, appends the siblings to the proof, and hashes each leaf's own digest in its place.

Many rows stand at the nodes near the root, so a node has a copy for every 64 runs below it, and the rows are dealt over the
copies; at each level that is a small share of the runs. Nothing but the number of leaves of the largest tree and the number of
sources is brought to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import numbered, setting, stored

FAN = 16
#: Rows of the climb that one copy of a node serves.
SHARE = 64
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _sealed(*parts: Column) -> Column:
    """SHA-256 of the parts together."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _field(value: Column) -> Column:
    """A value with its UTF-8 length before it, or a dash for null."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, tree (the source), leaf, changed: the digest of each row, and that of the row with its text as `tampered`.

    Without `tampered` the text's A-Z become lower case where 5 divides the CRC of doc_id. A null source is a tree of its own;
    rows with a null doc_id come first in theirs, and none of them is tampered with. Other columns are ignored.
    """
    rows = docs.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in _FIELDS])
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if tampered is None:
        tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower).otherwise(F.col("text"))
    values = {c: F.col(c).cast("string") for c in _FIELDS}
    sealed = lambda over: _sealed(*[_field(v) for v in (values | over).values()])
    return rows.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("tree"), sealed({}).alias("leaf"), sealed({"text": tampered}).alias("changed"))


def _name(kind: str, level: int, at: Column, tree: Column) -> Column:
    return F.concat(F.lit(f"{kind}{level}:"), at.cast("string"), F.lit(":"), tree)


def _slots(weight: Column) -> Column:
    return F.ceil(weight / SHARE).cast("long")


def _lifted(nodes: DataFrame, kind: str, level: int) -> DataFrame:
    """The parents of nodes (tree, at, id, digest, n, weight), with the children they are made of; trees of one node have none."""
    runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("at") / FAN).alias("up_at"), F.ceil(F.col("n") / FAN).alias("up_n"))
    runs = runs.agg(F.sort_array(F.collect_list(F.struct("at", "digest", "id", "weight"))).alias("kids"))
    digest = _sealed(F.array_join(F.transform("kids", lambda k: _hex(k["digest"])), ""))
    return runs.select("tree", F.col("up_at").alias("at"), _name(kind, level, F.col("up_at"), F.col("tree")).alias("id"), digest.alias("digest"), F.col("up_n").alias("n"), F.aggregate("kids", F.lit(0).cast("long"), lambda a, k: a + k["weight"]).alias("weight"), "kids")


def _links(parents: DataFrame, ends: Column, sub: Column) -> DataFrame:
    """A row for each child: id, slot (a copy for every 64 runs below), before and behind (its siblings), the parent's digest, `sub`
    (whether the parent is a source's subroot), up and up_slots (where the climb goes on; null at the root)."""
    one = parents.select("*", F.posexplode("kids").alias("place", "kid"))
    joined = lambda part: F.unhex(F.array_join(F.transform(part, lambda k: F.hex(k["digest"])), ""))
    out = one.select(
        F.col("kid.id").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), _slots(F.col("kid.weight")) - 1)).alias("slot"), joined(F.slice("kids", 1, F.col("place"))).alias("before"), joined(F.slice("kids", F.col("place") + 2, F.lit(FAN))).alias("behind"),
        "digest", sub.alias("sub"), F.when(~ends, F.col("id")).alias("up"), _slots(F.col("weight")).alias("up_slots"),
    )
    return out


def _built(nodes: DataFrame, kind: str, most: int, ends: bool, level: int = 0) -> tuple[list[DataFrame], list[DataFrame]]:
    """Build the trees above nodes: the links of every level, and the roots by the level at which they end.

    most: nodes of the largest tree. ends: whether nothing is above the trees' roots.
    """
    links, roots = [], [nodes.where("n = 1")]
    while most > 1:
        level, most = level + 1, math.ceil(most / FAN)
        parents = stored(_lifted(nodes, kind, level), f"level{level}")
        top = F.col("n") == 1
        links.append(_links(parents, top & F.lit(ends), top & F.lit(kind == "s")))
        nodes = parents.drop("kids")
        roots.append(nodes.where("n = 1"))
    return links, roots


def _all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for df in frames[1:]:
        whole = whole.unionByName(df)
    return whole


CLIMB = """
WITH RECURSIVE climb AS (
  SELECT run, members, proof, subroot, digest, up, up_slots FROM {runs}
  UNION ALL
  SELECT /*+ MERGE(n) */ c.run, transform(c.members, m -> named_struct('doc_id', m.doc_id, 'leaf', m.leaf, 'folded',
           unhex(sha2(concat(lower(hex(n.before)), lower(hex(m.folded)), lower(hex(n.behind))), 256)))),
         concat(c.proof, n.before, n.behind), CASE WHEN n.sub THEN n.digest ELSE c.subroot END, n.digest, n.up, n.up_slots
  FROM climb c JOIN {links} n ON n.id = c.up AND n.slot = pmod(c.run, c.up_slots)
)
SELECT run, members, proof, subroot, digest FROM climb WHERE up IS NULL"""


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of docs, equal rows too.

    folded_root is what the leaf, tampered or not, gives with the original siblings; verified says whether that is the root. A
    table without rows has none; a table of one row has its leaf as the root and the digest of nothing as its proof. Rows of one
    source and number ascend by their leaves.
    """
    spark = docs.sparkSession
    placed = numbered(stored(leaves(docs, tampered), "leaves"), "tree", "doc_id", "leaf", "changed")
    runs = placed.groupBy("tree", F.floor(F.col("at") / FAN).alias("at"), F.col("n").alias("leaves")).agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("k"), "doc_id", "leaf", "changed"))).alias("m"))
    several = F.col("leaves") > 1
    text = lambda ms: F.array_join(F.transform(ms, lambda m: _hex(m["leaf"])), "")
    sealed = lambda m, k: F.when(several, _sealed(text(F.slice("m", 1, k)), _hex(m["changed"]), text(F.slice("m", k + 2, F.lit(FAN))))).otherwise(m["changed"])
    members = F.transform("m", lambda m, k: F.struct(m["doc_id"].alias("doc_id"), m["leaf"].alias("leaf"), sealed(m, k).alias("folded")))
    runs = stored(runs.select(
        "tree", "at", F.ceil(F.col("leaves") / FAN).alias("n"), _name("s", 1, F.col("at"), F.col("tree")).alias("id"), F.when(several, _sealed(text(F.col("m")))).otherwise(F.col("m")[0]["leaf"]).alias("digest"),
        members.alias("members"), F.lit(1).cast("long").alias("weight"), F.pmod(F.xxhash64("tree", "at"), F.lit(2**40)).alias("run"),
    ), "runs")
    largest, sources = runs.agg(F.max("n"), F.count_if(F.col("at") == 0)).first()
    if largest is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    links, roots = _built(runs.select("tree", "at", "id", "digest", "n", "weight"), "s", largest, sources == 1, 1)
    subroots = numbered(_all(roots).select(F.lit("").alias("all"), "tree", "id", "digest", "weight"), "all", "tree")
    subroots = stored(subroots.withColumn("tree", F.lit("")).drop("all"), "subroots")
    upper, _ = _built(subroots, "t", sources, True)
    anchor = runs.select(
        "run", "members", F.unhex(F.lit("")).alias("proof"), F.when(F.col("n") == 1, F.col("digest")).alias("subroot"), "digest",
        F.when((F.col("n") > 1) | F.lit(sources > 1), F.col("id")).alias("up"), F.lit(1).cast("long").alias("up_slots"),
    )
    if not links and not upper:
        done = anchor.select("run", "members", "proof", "subroot", "digest")
    else:
        with setting(spark, "spark.sql.cteRecursionRowLimit", "-1"):  # read when the query runs
            done = stored(spark.sql(CLIMB, runs=anchor, links=_all(links + upper)), "climbed")
    others = lambda k: F.array_join(F.transform(F.filter("members", lambda m, j: j != k), lambda m: _hex(m["leaf"])), "")
    each = F.transform("members", lambda m, k: F.struct(m["doc_id"].alias("doc_id"), m["leaf"].alias("leaf"), m["folded"].alias("folded"), F.sha2(F.concat(others(k), _hex(F.col("proof"))), 256).alias("proof")))
    one = done.select("subroot", "digest", F.explode(each).alias("m"))
    return one.select("m.doc_id", _hex(F.col("m.leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("digest")).alias("root"), F.col("m.proof").alias("proof_sha256"), _hex(F.col("m.folded")).alias("folded_root"), (F.col("m.folded") == F.col("digest")).alias("verified"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_VALUE = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in _FIELDS) + ")"
_CHANGED = "sha256(" + " || ".join(_VALUE.format("low" if c == "text" else c) for c in _FIELDS) + ")"
_KIDS = "SELECT tree, lvl, pos // 16 AS up, list(h ORDER BY pos) AS hs FROM {0} WHERE n > 1 GROUP BY tree, lvl, pos // 16"
_STEP = """SELECT c.rid, k.tree, k.lvl + 1, c.pos // 16, (c.n + 15) // 16, c.proof || array_to_string(list_concat(hs[1:c.pos % 16], hs[c.pos % 16 + 2:]), ''),
    sha256(array_to_string(list_concat(list_concat(hs[1:c.pos % 16], [c.folded]), hs[c.pos % 16 + 2:]), '')) FROM {0} c JOIN {1} k ON k.tree = c.tree AND k.lvl = c.lvl AND k.up = c.pos // 16 WHERE c.n > 1"""
OP12_SQL = f"""WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
  crc AS (SELECT d.*, row_number() OVER () AS rid, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc FROM documents d, tab),
  low AS (SELECT *, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low FROM crc),
  leafed AS (SELECT rid, doc_id, coalesce('s' || source, '') AS tree, {_LEAF} AS leaf, {_CHANGED} AS changed FROM low),
  leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leafed),
  lv AS (SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM leaves UNION ALL SELECT tree, lvl + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY tree, lvl, pos // 16),
  subs AS MATERIALIZED (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
  tv AS (SELECT '' AS tree, 0 AS lvl, pos, n, subroot AS h FROM subs UNION ALL SELECT tree, lvl + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM tv WHERE n > 1 GROUP BY tree, lvl, pos // 16),
  ks AS MATERIALIZED ({_KIDS.format('lv')}), kt AS MATERIALIZED ({_KIDS.format('tv')}),
  cs AS (SELECT rid, tree, 0 AS lvl, pos, n, '' AS proof, changed AS folded FROM leaves UNION ALL {_STEP.format('cs', 'ks')}),
  ct AS (SELECT rid, '' AS tree, 0 AS lvl, s.pos, s.n, proof, folded FROM cs JOIN subs s ON s.source = cs.tree WHERE cs.n = 1 UNION ALL {_STEP.format('ct', 'kt')})
  SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified FROM leaves l JOIN subs s ON s.source = l.tree JOIN ct ON ct.rid = l.rid AND ct.n = 1 CROSS JOIN (SELECT h FROM tv WHERE n = 1) r"""
