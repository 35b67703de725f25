"""Fixity audit of WARC replicas by Merkle trees over ordered records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, fresh, materialize

#: Slots of an archive: record ids run through its slots in order.
SLOTS = 4096
#: Children of a node.
FANOUT = 16
#: Archive of the records without an id.
NO_ARCHIVE = -1
#: Folders that a replica's tables are split into by ranges of archives, at most, so that an audit reads those of bad archives alone.
ZONES = 256

_LEVELS = 3  # slots = FANOUT ** 3


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(record_id, length, digest) of each page as a WARC resource record; a null url or body is an empty one."""
    url, body = (F.coalesce(col(pages, c).cast("string"), F.lit("")) for c in (url_col, html_col))
    number = col(pages, id_col).cast("long")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(head, body, F.lit("\r\n\r\n"))
    return pages.select(number.alias("record_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))


def archive_of(record_id: Column) -> Column:
    # floor of a negative id is negative: shifted so that -1 stays free for records without an id
    archive = F.floor(record_id / SLOTS).cast("long")
    return F.coalesce(F.when(record_id < 0, archive - 1).otherwise(archive), F.lit(NO_ARCHIVE))


def zones(*replicas: DataFrame) -> tuple[int, int]:
    """(least archive, archives in a zone) for replicas of records: ZONES zones at most hold them all."""
    ends = [x.agg(F.min(archive_of(F.col("record_id"))), F.max(archive_of(F.col("record_id")))).first() for x in replicas]
    low, high = min((e[0] for e in ends if e[0] is not None), default=0), max((e[1] for e in ends if e[1] is not None), default=0)
    return low, -(-(high - low + 1) // ZONES)


def leaves(recs: DataFrame, zoning: tuple[int, int] = (0, 1)) -> DataFrame:
    """(archive, slot, copy, record_id, start, length, digest, zone): records by archive in order, each with its offset there, in the shared folder, in a folder by zone.

    An archive holds 4096 consecutive ids, an id's slot being its place among them, so that a record which a replica lacks moves
    no other record to another branch.  Records that repeat an id are copies, ordered by digest.
    """
    slot = F.coalesce(F.pmod("record_id", F.lit(SLOTS)), F.lit(0))
    placed = recs.select(archive_of(F.col("record_id")).alias("archive"), slot.alias("slot"), "record_id", "length", "digest")
    copy = F.row_number().over(Window.partitionBy("archive", "slot").orderBy("digest"))
    order = Window.partitionBy("archive").orderBy("slot", "copy")
    start = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # both windows and the trees use the partitioning by archive
    placed = placed.repartition("archive").withColumn("copy", copy.cast("long"))
    return materialize(placed.select("archive", "slot", "copy", "record_id", start.alias("start"), "length", "digest", _zone(zoning).alias("zone")), "leaves", by="zone")


def _zone(zoning: tuple[int, int]) -> Column:
    return F.floor((F.col("archive") - zoning[0]) / zoning[1]).cast("long")


def _parent(children: DataFrame, node: Column, order: str) -> DataFrame:
    """The nodes above: each hashes its children's hashes in order, and spans their offsets."""
    kids = F.sort_array(F.collect_list(F.struct(order, "digest")))
    return children.groupBy("archive", "zone", node.alias("node")).agg(F.sha2(F.array_join(F.transform(kids, lambda x: x["digest"]), ""), 256).alias("digest"), F.min("start").alias("start"), F.max("stop").alias("stop"))


def levels(leaf: DataFrame) -> list[DataFrame]:
    """The trees' levels from the ranges above the records up to the roots, each (archive, zone, node, digest, start, stop).

    All levels keep the partitioning by archive of the first, so they cost one shuffle of the leaves.  The leaves' digests
    are bound to their lengths and places by the order.
    """
    own = leaf.select("archive", "zone", "slot", "copy", "start", (F.col("start") + F.col("length")).alias("stop"), F.concat_ws(":", "slot", "copy", "length", "digest").alias("digest"))
    own = own.withColumn("at", F.col("slot") * (1 << 32) + F.col("copy")).repartition("archive")
    out = [_parent(own, F.floor(F.col("slot") / FANOUT), "at")]
    for _ in range(_LEVELS - 1):
        below = out[-1].withColumnRenamed("node", "below").withColumn("digest", F.concat_ws(":", "below", "digest"))
        out.append(_parent(below, F.floor(F.col("below") / FANOUT), "below"))
    return [materialize(x, "level", by="zone") for x in out]


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, archive, node, copy, record_id, status, start_a, stop_a, start_b, stop_b) of each node at which replicas a and b differ.

    a and b are records (record_id, length, digest), one row for each record.  Level 3 has the archives' roots, levels 2 and 1
    ranges of 256 and 16 ids, level 0 the records themselves (node is the record's slot).  Roots are compared first;
    from then on only the zones that hold children of nodes that differ are read, and only these children compared.  status: "differs", or "only in a" or
    "only in b" for what a replica lacks.  start and stop are byte offsets in the archive of each replica.

    Edge cases: records without an id are in archive -1.  Records that repeat an id are told apart by their copy number, in the order
    of their digests; those with the same digest tie, and any of them may have the lower number.  Bodies are hashed whole, however long.  Other
    columns aren't read.  Equal replicas give no row, an empty replica one for each node of the other.
    """
    zoning = zones(a, b)
    leaf_a, leaf_b = leaves(a, zoning), leaves(b, zoning)
    tree_a, tree_b = levels(leaf_a), levels(leaf_b)
    found, bad = [], None
    for k in range(_LEVELS, -1, -1):
        x, y = (tree_a[k - 1], tree_b[k - 1]) if k else (_records_of(leaf_a), _records_of(leaf_b))
        keys = ["archive", "node"] if k else ["archive", "node", "copy"]
        if bad is not None:
            x, y = (_under(z.where(F.col("zone").isin(where)), bad) for z in (x, y))
        more = [] if k else ["record_id"]
        x = x.select(*keys, *(F.col(c).alias(f"{c}_a") for c in ("digest", "start", "stop", *more)))
        y = y.select(*keys, *(F.col(c).alias(f"{c}_b") for c in ("digest", "start", "stop", *more)))
        both = x.join(y, keys, "full").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        status = F.when(F.col("digest_a").isNull(), "only in b").when(F.col("digest_b").isNull(), "only in a").otherwise("differs")
        none = F.lit(None).cast("long")
        record = F.coalesce("record_id_a", "record_id_b") if not k else none
        here = both.select(F.lit(k).alias("level"), "archive", "node", (F.col("copy") if not k else none).alias("copy"), record.alias("record_id"), status.alias("status"), "start_a", "stop_a", "start_b", "stop_b")
        if k:
            here = materialize(here, "differing")
            bad = here.select("archive", F.col("node").alias("above"))
            where = [r["zone"] for r in bad.select(_zone(zoning).alias("zone")).distinct().collect()]  # ZONES bounds it
        found.append(here)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _records_of(leaf: DataFrame) -> DataFrame:
    return leaf.select("archive", "zone", F.col("slot").alias("node"), "copy", "record_id", "start", (F.col("start") + F.col("length")).alias("stop"), F.concat_ws(":", "length", "digest").alias("digest"))


def _under(nodes: DataFrame, bad: DataFrame) -> DataFrame:
    """The nodes whose parents are among ``bad``."""
    above, = fresh(nodes, "above")
    return nodes.withColumn(above, F.floor(F.col("node") / FANOUT)).join(bad.select("archive", F.col("above").alias(above)), ["archive", above], "left_semi").drop(above)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages(page_id, url, html) as a failing store might return it, the same one each time.

    By the MD5 of its id about one page in 256 has a byte changed, one is lost and one is there twice.
    """
    lot = F.substring(F.md5(col(pages, "page_id").cast("string")), 1, 2)
    half = F.floor(F.length("html") / 2).cast("int")
    rotten = F.concat(F.substring("html", F.lit(1), half), F.lit("\x7f"), F.col("html").substr(half + 2, F.length("html")))
    there = pages.select("page_id", "url", F.when(lot == "00", rotten).otherwise(F.col("html")).alias("html"), F.coalesce(lot, F.lit("")).alias("lot"))
    copies = F.when(F.col("lot") == "01", F.array().cast("array<int>")).when(F.col("lot") == "02", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return there.select("page_id", "url", "html", F.explode(copies)).drop("col")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drill over all pages: the archive of the pages against a replica with known damage."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return audit(records(pages), records(damaged(pages)))


def _sql() -> str:
    def recs(source: str) -> str:
        body, url = "coalesce(html, '')", "coalesce(url, '')"
        text = f"'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || {url} || chr(13) || chr(10) || 'Content-Length: ' || strlen({body}) || chr(13) || chr(10) || chr(13) || chr(10) || {body} || chr(13) || chr(10) || chr(13) || chr(10)"
        return f"""SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY slot, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM (SELECT *, row_number() OVER (PARTITION BY archive, slot ORDER BY digest) AS copy
      FROM (SELECT page_id AS record_id, page_id // {SLOTS} AS archive, page_id % {SLOTS} AS slot, strlen(record) AS length, sha256(record) AS digest FROM (SELECT page_id, {text} AS record FROM {source})))"""

    parts = [f"""WITH rotten AS (
  SELECT page_id, url, CASE WHEN lot = '00' THEN substr(html, 1, length(html) // 2) || chr(127) || substr(html, length(html) // 2 + 2) ELSE html END AS html
  FROM (SELECT *, substr(md5(page_id::VARCHAR), 1, 2) AS lot FROM pages), (SELECT unnest([1, 2]) AS k) WHERE k <= CASE lot WHEN '01' THEN 0 WHEN '02' THEN 2 ELSE 1 END),
a0 AS ({recs("pages")}),
b0 AS ({recs("rotten")})"""]
    for x in "ab":
        parts.append(f"""{x}1 AS (
  SELECT archive, slot // {FANOUT} AS node, sha256(string_agg(slot || ':' || copy || ':' || length || ':' || digest, '' ORDER BY slot, copy)) AS digest, min(start) AS start, max(start + length) AS stop
  FROM {x}0 GROUP BY 1, 2)""")
        for k in range(2, _LEVELS + 1):
            parts.append(f"""{x}{k} AS (
  SELECT archive, node // {FANOUT} AS node, sha256(string_agg(node || ':' || digest, '' ORDER BY node)) AS digest, min(start) AS start, max(stop) AS stop
  FROM {x}{k - 1} GROUP BY archive, node // {FANOUT})""")
        parts.append(f"{x}r AS (SELECT archive, slot AS node, copy, record_id, start, start + length AS stop, length || ':' || digest AS digest FROM {x}0)")
    ends = []
    for k in range(_LEVELS, -1, -1):
        n = k or "r"
        copy, record = ("NULL::BIGINT", "NULL::BIGINT") if k else ("coalesce(a.copy, b.copy)", "coalesce(a.record_id, b.record_id)")
        on = "a.archive = b.archive AND a.node = b.node" + ("" if k else " AND a.copy = b.copy")
        ends.append(f"""SELECT {k}::INTEGER AS level, coalesce(a.archive, b.archive) AS archive, coalesce(a.node, b.node) AS node, {copy} AS copy, {record} AS record_id,
  CASE WHEN a.digest IS NULL THEN 'only in b' WHEN b.digest IS NULL THEN 'only in a' ELSE 'differs' END AS status, a.start AS start_a, a.stop AS stop_a, b.start AS start_b, b.stop AS stop_b
FROM a{n} a FULL JOIN b{n} b ON {on} WHERE a.digest IS DISTINCT FROM b.digest""")
    return ",\n".join(parts) + "\n" + "\nUNION ALL ".join(ends)


SQL = _sql()
