"""Operator 4, line dedup by content-defined line chunks, in DataFrame functions only.

A rolling hash over the hashes of the last two lines marks lines; a chunk ends at a marked line whose line before is not
marked, so boundaries depend on what stands around them and not on how many lines came before. A run of equal lines is
never cut, and chunks have two lines or more, four on average. Chunks whose hash occurs again anywhere are grouped by a
digest; the first occurrence's bytes travel to the others and are compared with theirs, and those that are equal go.
Texts are written once in buckets, so that afterwards only digests and the bytes of repeated chunks move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, materialize, text_bytes

#: The rolling hash: the line's hash plus FACTOR times that of the line before, modulo a prime; every MARKED-th value marks.
FACTOR, PRIME, MARKED = 1_000_003, 2_147_483_647, 2
#: Parts that each group of equal chunks is dealt over; chunks for each part in which the first one's bytes are sent.
SALTS, PART = 16, 4096
#: Bytes of text of a task.
TASK_BYTES = 32 << 20


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunked(docs: DataFrame) -> DataFrame:
    """``docs`` with the chunks of its column text in its place: k (from 0), n (lines), body (lines joined by LF)."""
    full = F.col("text").isNotNull() & (F.col("text") != "")
    others = [c for c in docs.columns if c != "text"]
    lines = docs.select(*others, F.when(full, F.split("text", "\n", -1)).otherwise(F.array().cast("array<string>")).alias("lines"))
    hashed = lines.withColumn("h", F.transform("lines", _line_hash))
    before = lambda i: F.when(i > 0, F.get("h", i - 1)).otherwise(F.lit(0))
    rolled = lambda h, i: (h + FACTOR * before(i)) % PRIME
    marks = lambda h, i: (rolled(h, i) % MARKED == 0) & ~h.eqNullSafe(F.get("h", i + 1))
    marked = hashed.withColumn("marks", F.transform("h", marks))
    last = F.size("h") - 1
    inner = lambda m, i: m & ~F.get("marks", i - 1) & (i < last - 1)
    ends_here = lambda m, i: F.when(i == last, True).when(i == 0, False).otherwise(inner(m, i))
    marked = marked.withColumn("ends", F.filter(F.transform("marks", lambda m, i: F.when(ends_here(m, i), i)), lambda i: i.isNotNull()))
    begin = lambda k: F.when(k > 0, F.get("ends", k - 1) + 1).otherwise(F.lit(0))
    body = lambda end, k: F.array_join(F.slice("lines", begin(k) + 1, end - begin(k) + 1), "\n")
    chunks = F.transform("ends", lambda end, k: F.struct(k.alias("k"), (end - begin(k) + 1).alias("n"), body(end, k).alias("body")))
    return marked.select(*others, chunks.alias("chunks"))


def repeated(rows: DataFrame) -> DataFrame:
    """row, gone: k and body of the first equal chunk, for the chunks of ``rows`` (row, doc_id, text) that go: those of two
    lines or more with an equal one in a smaller doc_id (null ids last) or earlier in the document."""
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "k", "row")
    chunks = chunked(rows).select("row", "doc_id", F.explode(F.filter("chunks", lambda c: c["n"] > 1)).alias("c"))
    chunks = materialize(chunks.select("row", "doc_id", "c.k", F.unhex(F.sha2("c.body", 256)).alias("digest")))
    first = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1")
    first = materialize(first.withColumn("parts", F.least(F.lit(SALTS), F.ceil(F.col("times") / PART)).cast("int")))
    salted = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n) - 1 if isinstance(n, int) else F.col(n) - 1)).alias("salt")
    salt = F.pmod(F.xxhash64("row", "k"), F.lit(SALTS)).cast("int")
    later = chunks.withColumn("salt", salt).join(first.select("*", salted(SALTS)), ["digest", "salt"])  # a frequent chunk meets in many tasks
    later = later.filter((F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.k") == F.col("k"))) == F.lit(False))
    later = later.select("row", "k", "digest", F.pmod("salt", "parts").cast("int").alias("salt"))
    owned = first.groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct("first.k", "digest", "parts")).alias("owned"))
    firsts = chunked(rows.select("row", "text")).join(owned, "row")
    sent = F.transform("owned", lambda o: F.struct(o["digest"].alias("digest"), o["parts"].alias("parts"), F.get("chunks", o["k"])["body"].alias("body")))
    firsts = firsts.select(F.explode(sent).alias("s")).select("s.*").select("digest", "body", salted("parts"))
    gone = later.join(firsts, ["digest", "salt"])
    return gone.groupBy("row").agg(F.collect_list(F.struct("k", "body")).alias("gone"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (text) of each document.

    Null and empty texts have no lines; a text of any length is cut whole, and an empty table gives no rows. Rows that
    repeat a doc_id are one document: equal chunks at the same place in them share their fate. A text that loses nothing
    comes back byte for byte.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes(docs) // TASK_BYTES)
    rows = bucketed(rows, "row", tasks)
    cut = chunked(rows.join(materialize(repeated(rows)), "row", "left"))
    none = F.array().cast("array<struct<k:int,body:string>>")
    equal = F.filter(F.coalesce("gone", none), lambda g: F.get("chunks", g["k"])["body"] == g["body"])  # byte by byte
    everyone = F.transform("chunks", lambda c: c["k"])
    picked = cut.withColumn("out", F.transform(equal, lambda g: g["k"]))
    picked = picked.withColumn("left", F.array_except(everyone, "out"))
    lines = lambda ks: F.aggregate(ks, F.lit(0).cast("long"), lambda s, k: s + F.get("chunks", k)["n"])
    kept = F.array_join(F.transform("left", lambda k: F.get("chunks", k)["body"]), "\n")
    return picked.select("doc_id", lines(everyone).alias("n_lines"), lines(F.col("out")).alias("n_removed"), kept.alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents WHERE text <> ''),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS v FROM l),
m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS lines, coalesce((v + 1000003 * lag(v, 1, 0) OVER w) % 2147483647 % 2 = 0 AND v IS DISTINCT FROM lead(v) OVER w, FALSE) AS m
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, i = lines OR (m AND NOT lag(m, 1, TRUE) OVER (PARTITION BY doc_id ORDER BY i) AND i < lines - 1) AS e FROM m),
g AS (SELECT *, coalesce(sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
c AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY doc_id, k),
f AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY body, n > 1 ORDER BY doc_id, k) > 1 AS gone FROM c),
o AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS n_removed,
             coalesce(string_agg(CASE WHEN gone THEN NULL ELSE body END, chr(10) ORDER BY k), '') AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
