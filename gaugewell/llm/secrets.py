"""Operator 2, secret scans with a random forest that removes false positives, in DataFrame functions and MLlib only.

Candidates are long runs of token characters. The forest sees their length, character classes and transitions, how much
of them dictionary words cover, the path, and the neighbouring words on both sides; it is trained from labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a candidate; its shortest length and the characters of context on either side, both parameters of
#: ``candidates`` and ``scan``; labelled findings of ``labelled``.
TOKEN, SHORTEST, CONTEXT, FINDINGS = r"A-Za-z0-9+/_\-", 16, 64, 8000
#: Tokens that are placed at once.
PART = 512
TREES, DEPTH, THRESHOLD, SEED = 30, 9, 0.5, 42

#: Frequent words and syllables of prose and code, for dictionary coverage.
DICTIONARY = (
    "about after also and are back because been before being between both but can come could data date day default down each even example "
    "field file find first for from function get give good have her here him his how index into its item just key know label like line list "
    "long look make many may message model more most name new not now number object one only other our out over own path people place "
    "return right say see set she should some string such table take test text than that the their them then there these they thing this "
    "time tion token two type use user value very was way well were what when where which while who will with word work would year you "
    "ing ment heit keit ung lich schaft cion mente que eau aux ique ent ere ant est ous ive ess"
).split()
#: Words beside a secret, beside a harmless digest, and of paths that hold examples.
NEAR_SECRET = "token|secret|password|passwd|pwd|api[_-]?key|apikey|access|private|credential|auth|bearer|client"
NEAR_DIGEST = "commit|sha\\d*|md5|checksum|digest|hash|etag|revision|uuid|version|build|fingerprint|integrity|base64"
EXAMPLE_PATH = "test|example|sample|fixture|mock|docs?"

FEATURES = ["length", "digits", "uppers", "hexes", "marks", "different", "transitions", "mixed", "vowels", "covered", "keyword", "digestword", "assigned", "quoted", "closed", "nextword", "path"]


def candidates(docs: DataFrame, path: str = "source", shortest: int = SHORTEST, context: int = CONTEXT) -> DataFrame:
    """doc_id, path, token, start (from 0, in characters), before, after: every run of at least ``shortest`` token
    characters at every place where it stands, with ``context`` characters on either side. Null and empty texts have
    none; rows that repeat a document repeat its candidates; an empty table gives no rows.

    The text is parted by the same pattern, so starts are sums of lengths. Tokens go on in parts of PART, which keeps
    the work on a long document in proportion to its length.
    """
    reach = -(-context // shortest)  # tokens that the context goes back or on over at most
    run = rf"(?<![{TOKEN}])[{TOKEN}]{{{shortest},}}={{0,2}}"
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    text = F.col("text").cast("string")
    found = docs.select("doc_id", where.alias("path"), F.regexp_extract_all(text, F.lit(run), 0).alias("tokens"), F.split(text, run, -1).alias("gaps"))
    found = found.withColumn("steps", F.zip_with("gaps", "tokens", lambda g, t: (F.length(g) + F.coalesce(F.length(t), F.lit(0))).cast("long")))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    firsts = F.filter(F.sequence(F.lit(0), F.size("tokens"), F.lit(PART)), lambda i: i < F.size("tokens"))
    found = found.withColumn("parts", F.transform(firsts, lambda i: F.struct(i.alias("first"), total(F.slice("steps", i + 1, PART)).alias("length"))))
    # the context of a part's tokens reaches over ``reach`` tokens before its first and behind its last
    back = lambda i: F.greatest(i - reach, F.lit(0))
    cut = lambda xs, i: F.slice(xs, back(i) + 1, i - back(i) + PART + reach + 1)
    ends = lambda g: F.struct(F.length(g).alias("n"), F.left(g, F.lit(context)).alias("head"), F.right(g, F.lit(context)).alias("tail"))
    part = F.transform(
        "parts",
        lambda p, k: F.struct(
            F.aggregate(F.slice("parts", 1, k), F.lit(0).cast("long"), lambda a, q: a + q["length"]).alias("offset"),
            (p["first"] - back(p["first"])).alias("skip"),
            cut("tokens", p["first"]).alias("tokens"),
            F.transform(cut("gaps", p["first"]), ends).alias("gaps"),
            F.slice("steps", p["first"] + 1, F.least(F.lit(PART), F.size("tokens") - p["first"])).alias("steps"),
        ),
    )
    parts = found.select("doc_id", "path", F.explode(part).alias("p")).select("doc_id", "path", "p.*")
    begins = F.aggregate("steps", F.array("offset"), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    parts = parts.select("doc_id", "path", "skip", "tokens", "gaps", F.size("steps").alias("own"), begins.alias("begins"))
    side = lambda j, name: F.coalesce(F.get("gaps", j)[name], F.lit(""))
    ending = lambda j: F.coalesce(F.right(F.get("tokens", j), F.lit(context)), F.lit(""))
    begin = lambda j: F.coalesce(F.left(F.get("tokens", j), F.lit(context)), F.lit(""))
    before = lambda j: F.right(F.concat(*[f for d in range(reach, 0, -1) for f in (side(j - d, "tail"), ending(j - d))], side(j, "tail")), F.lit(context))
    after = lambda j: F.left(F.concat(side(j + 1, "head"), *[f for d in range(1, reach + 1) for f in (begin(j + d), side(j + d + 1, "head"))]), F.lit(context))
    start = lambda j: F.get("begins", j - F.col("skip")) + F.get("gaps", j)["n"]
    each = F.transform(
        F.sequence(F.col("skip"), F.col("skip") + F.col("own") - 1),
        lambda j: F.struct(F.get("tokens", j).alias("token"), start(j).alias("start"), before(j).alias("before"), after(j).alias("after")),
    )
    return parts.select("doc_id", "path", F.explode(each).alias("t")).select("doc_id", "path", "t.token", "t.start", "t.before", "t.after")


def features(found: DataFrame) -> DataFrame:
    """The numbers that the forest sees, from token, before, after and path (null counts as empty)."""
    t, n = F.col("token"), F.length("token")
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    before, after = F.lower(F.coalesce("before", F.lit(""))), F.lower(F.coalesce("after", F.lit("")))
    last = F.regexp_replace(F.trim(F.element_at(F.split(F.rtrim(F.regexp_replace(before, r"[\"'`=:,\s]+$", "")), r"\s+"), -1)), r"[^a-z0-9_\-]", "")
    next_ = F.regexp_extract(after, r"^[\"'`,;:.()\s]*([a-z0-9_\-]*)", 1)
    flag = lambda c: c.cast("double")
    numbers: dict[str, Column] = {
        "length": F.least(n, F.lit(200)).cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "hexes": share("[0-9a-fA-F]"),
        "marks": share("[+/_=-]"),
        "different": F.size(F.array_distinct(F.split(t, ""))) / F.least(n, F.lit(64)),
        "transitions": F.regexp_count(t, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])")) / n,
        "mixed": F.regexp_count(t, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) / n,
        "vowels": F.regexp_count(F.lower(t), F.lit("(?<=[aeiou])(?=[a-z&&[^aeiou]])")) / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower(t), words, "")) / n,
        "keyword": flag(last.rlike(NEAR_SECRET)),
        "digestword": flag(last.rlike(f"({NEAR_DIGEST})$")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(before.rlike(r"[\"'`]$")),
        "closed": flag(after.rlike(r"^[\"'`]")),
        "nextword": flag(next_.rlike(f"^({NEAR_DIGEST})$")),
        "path": flag(F.coalesce(F.lower("path").rlike(EXAMPLE_PATH), F.lit(False))),
    }
    return found.withColumns({k: v.cast("double") for k, v in numbers.items()})


def labelled(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """Labelled findings (kind, token, before, after, path, label) of the kinds that reviewers see. Secrets are hex and
    base64 keys beside telling names, and random mixed characters, with or without a vendor's prefix, anywhere.
    Harmless are digests, identifiers, names of things in every case, numbers, placeholders and long words, some of them
    beside telling names too. The same on every run."""
    i = spark.range(rows).withColumn("u", F.abs(F.xxhash64("id", F.lit(SEED)))).withColumn("hex", F.sha2(F.col("u").cast("string"), 256))
    roll = lambda salt, n: F.pmod(F.xxhash64("u", F.lit(salt)), F.lit(n)).cast("int")
    pick = lambda salt, *xs: F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), roll(salt, len(xs)))
    long_ = F.concat(F.base64(F.unhex("hex")), F.base64(F.unhex(F.sha2("hex", 256))))
    base, alnum = F.regexp_replace(long_, "=", ""), F.regexp_replace(long_, "[+/=]", "")
    upper = F.upper(F.regexp_replace(alnum, "[018]", "Q"))
    cut = lambda c, salt, low, high: F.substring(c, F.lit(1), F.lit(low) + roll(salt, high - low + 1))
    hexes = F.substring("hex", F.lit(1), pick("hx", F.lit(16), F.lit(18), F.lit(24), F.lit(32), F.lit(40), F.lit(64)))
    syllable = lambda k: pick(k, "tion", "ing", "the", "ouer", "heit", "ment", "and", "ando", "que", "eau", "lich", "er", "data", "user", "value", "index", "file", "map", "cache", "get", "server", "build", "node", "query", "option", "stat", "able")
    words = [syllable(f"s{k}") for k in range(6)]
    title = [F.initcap(w) for w in words]
    prefix = pick("pf", "ghp_", "gho_", "sk_test_", "rk_", "pat-", "tok_", "key-", "npm_", "SG-", "shpat_")
    placeholder = pick("ph", "your-secret-key-goes-here", "your_access_token_here", "xxxxxxxxxxxxxxxxxxxxxxxx", "REPLACE_WITH_YOUR_TOKEN", "insert-password-here", "changeme_changeme_changeme", "0000000000000000000000", "example-api-key-value", "aaaaaaaaaaaaaaaaaaaaaa")
    uuid = F.concat_ws("-", F.substring("hex", 1, 8), F.substring("hex", 9, 4), F.substring("hex", 13, 4), F.substring("hex", 17, 4), F.substring("hex", 21, 12))
    name = pick("a", "token", "secret", "password", "api_key", "access_key", "client_secret", "auth", "passwd", "private_key", "APIKEY")
    sign, quote = pick("e", " = ", ": ", "=", " := "), pick("qu", "", '"', "'")
    told = F.concat(pick("b", "the ", "of ", "with ", "", "einem ", "la "), name, sign, quote)
    prose = F.concat(pick("c", "see ", "in ", "at ", "", "de ", "und "), pick("d", "the", "of", "file", "and", "was", "for", "der", "que", "this", "les"), pick("f", " ", " ", ", ", ": "))
    digest = F.concat(pick("g", "see ", "in ", "at ", ""), pick("h", "commit", "sha256", "md5", "checksum", "digest", "revision", "etag", "hash"), pick("m", " ", " ", ": ", "="))
    code = F.concat(pick("co", "id", "name", "path", "key", "class", "type", "import", "url"), sign, quote)
    anywhere = pick("w", told, prose, prose, code)
    plain = pick("pl", prose, prose, digest, code)
    kinds = [  # kind, label, token, before
        ("hex key", 1, hexes, told),
        ("base64 key", 1, cut(base, "k1", 20, 80), told),
        ("random", 1, cut(alnum, "k2", 18, 64), anywhere),
        ("upper random", 1, F.concat(F.upper(F.substring(F.translate("hex", "0123456789", "ghijklmnop"), 1, 4)), F.substring(upper, 1, 16)), anywhere),
        ("prefixed", 1, F.concat(prefix, cut(alnum, "k3", 20, 44)), anywhere),
        ("upper hex key", 1, F.upper(hexes), told),
        ("grouped", 1, F.concat_ws("-", pick("gp", "app", "bot", "usr", "svc"), F.substring(F.translate("hex", "abcdef", "739154"), 1, 11), cut(alnum, "k4", 20, 32)), anywhere),
        ("long word", 0, F.concat(*words), anywhere),
        ("digest", 0, hexes, pick("dg", digest, digest, prose)),
        ("uuid", 0, uuid, plain),
        ("placeholder", 0, placeholder, told),
        ("path", 0, F.concat(pick("p0", "/", "", "../"), words[0], F.lit("/"), words[1], F.lit("_"), words[2], F.lit("/"), words[3], words[4]), anywhere),
        ("snake", 0, F.concat_ws("_", words[0], words[1], words[2], words[3]), anywhere),
        ("kebab", 0, F.concat_ws("-", words[0], words[1], words[2], F.concat(words[3], words[4])), anywhere),
        ("camel", 0, F.concat(words[0], *title[1:5]), anywhere),
        ("constant", 0, F.upper(F.concat_ws("_", words[0], words[1], words[2], words[3])), anywhere),
        ("number", 0, F.substring(F.translate("hex", "abcdef", "739154"), F.lit(1), F.lit(16) + roll("nu", 8)), plain),
        ("rule", 0, F.repeat(pick("ru", "-", "_", "-", "+"), F.lit(16) + roll("rl", 60)), prose),
        ("shout", 0, F.upper(F.concat(*words[:4])), anywhere),
        ("embedded file", 0, cut(base, "em", 40, 86), pick("ef", "data:image/png;base64,", "src=data:font/woff2;base64,", "(data:image/gif;base64,")),
        ("integrity", 0, F.concat(pick("ig", "sha512-", "sha384-", "sha256-"), cut(base, "in", 40, 86)), pick("ih", 'integrity="', "integrity: ", "integrity=")),
    ]
    secrets, harmless = [k for k in kinds if k[1]], [k for k in kinds if not k[1]]
    of = lambda j: F.when(F.col("id") % 2 == 0, pick("kind", *[k[j] for k in secrets])).otherwise(pick("kind", *[k[j] for k in harmless]))
    after = F.concat(F.regexp_extract(of(3), "([\"'])$", 1), pick("af", " und", ", and the", "\n", ". The", "", ";", " is", " checksum", " for"))
    path = pick("q", "src/main", "config", "app", "tests/fixtures", "docs", "lib", "web", "s1")
    return i.select("id", of(0).alias("kind"), (F.col("id") % 2 == 0).cast("double").alias("label"), of(2).alias("token"), of(3).alias("before"), after.alias("after"), path.alias("path"))


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest from labelled findings; they fit one task (thousands of reviewed rows), which makes runs agree."""
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(findings)).repartition(1).sortWithinPartitions("id")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(table)


def scan(docs: DataFrame, model: RandomForestClassificationModel, path: str = "source", shortest: int = SHORTEST, context: int = CONTEXT) -> DataFrame:
    """doc_id, start, token, score, secret for every candidate; ``secret`` is whether the forest keeps the finding.

    Texts of any length are scanned whole; null and empty ones have no candidates, rows that repeat a document repeat its
    findings, and an empty table gives no rows. Other columns, whatever their names, are not looked at.
    """
    seen = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(docs, path, shortest, context)))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(seen).select("doc_id", "start", "token", score.alias("score"), (score >= THRESHOLD).alias("secret"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(labelled(spark)))
    return found.select("doc_id", F.col("start").cast("long"), F.length("token").cast("long").alias("n_chars"), F.sha2("token", 256).alias("token_sha256"), F.round("score", 6).alias("score"), "secret")
