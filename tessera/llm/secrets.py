"""Operator 10, secret scans with a random forest against false positives
(DataFrame and SQL functions only).

Candidates are strings in the format of a provider's key, private key blocks,
passwords inside addresses (``scheme://user:password@host``), values assigned to a
name like ``password`` or ``token`` (markup may stand around name and value), and
long runs of key characters. A random forest judges each candidate by its length, character
transitions, coverage by dictionary words, path, and neighbouring words; what it
rejects is a false positive. The trained trees become one SQL expression, so
documents are judged row by row: no shuffle of texts, no hot key.

The dictionary is the ``DICTIONARY`` words of highest document frequency, counted
over the whole corpus. The forest is trained on labelled findings: a bounded
sample (``TRAIN_ROWS``, by hash) of the corpus's candidates that the
labelling rules below decide, and ``SEED_ROWS`` made ones that hold each rule's
pattern at any corpus size. Training rows are put into one total order in one
partition first (they are bounded), so the forest does not depend on how the
documents are partitioned. Digests, commit ids and UUIDs without the name of a key
beside them are false positives. A table of reviewed findings can be given instead.

Defined cases: a null text has no candidates and stays null; a null source has
no path words; repeated rows and null keys keep a row each; empty tables give no
rows (the forest is then trained on the made findings); texts of any length are
taken whole; clashing extra columns are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.counts import frequent, keep

DICTIONARY = 4096
TRAIN_ROWS = 20_000
SEED_ROWS = 1_200
TREES, DEPTH, FOREST_SEED = 20, 6, 11
MASK = "[SECRET]"

# Candidate patterns (all loops are over single characters or possessive: no recursion on long texts).
# A block ends at its END line; dashes inside are part of it, another BEGIN line is not.
PEM = ("-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+"
       "-----END [A-Z ]{0,20}PRIVATE KEY-----")
PROVIDER = (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}|\bxox[abprs]-[A-Za-z0-9-]{10,}"
            r"|\bsk_(?:live|test)_[A-Za-z0-9]{16,}|\bAIza[0-9A-Za-z_-]{35}"
            r"|\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}")
NAMES = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret|auth[_-]?token"
TAGS = "(?:</?[A-Za-z]{1,10}>){0,2}"
ASSIGN = rf"(?i:\b[A-Za-z0-9_]*(?:{NAMES})\b[\"']?{TAGS}\s{{0,3}}[:=]\s{{0,3}}{TAGS}\s{{0,3}}[\"']?)"
ASSIGNED = ASSIGN + r"(?:[^\s\"'<]|<(?!/)){6,}+"
ADDRESS = r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@\"']{0,40}:"
ADDRESSED = ADDRESS + r"[^\s/@\"']{4,}+(?=@)"
GENERIC = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
CANDIDATE = f"(?:{PEM}|{PROVIDER}|{ADDRESSED}|{ASSIGNED}|{GENERIC})"
# up to two words before a candidate and what stands in its own word, from so many characters
CONTEXT, BEFORE = r"(?:\S{1,40}\s{1,5}){0,2}\S{0,40}\z", 130
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|your|change.?me|xxxx|todo|fake|redacted|<|\\*\\*\\*"
PATH_WORDS = "(?i)test|example|sample|mock|fixture|docs?\\b"


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of 3 to 20 ASCII letters (lower case) by
    document frequency, ``size`` at most."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"))
    counts = docs.select(F.explode(words).alias("w")).filter("length(w) BETWEEN 3 AND 20") \
        .groupBy("w").agg(F.count("*").alias("n"))
    return sorted(r["w"] for r in frequent(counts, size).select("w").collect())


def candidates(text: Column, source: Column) -> Column:
    """Array of (kind, value, context, source) found in a text."""
    def part(found: Column, before: Column) -> Column:
        kind = F.when(found.rlike(f"^{PEM}$"), "private key").when(found.rlike(f"^(?:{PROVIDER})$"), "provider key") \
            .when(found.rlike(f"^{ADDRESS}"), "address").when(found.rlike(f"^{ASSIGNED}$"), "assigned") \
            .otherwise("generic")
        value = F.when(kind == "assigned", F.regexp_replace(found, f"^{ASSIGN}", "")) \
            .when(kind == "address", F.regexp_replace(found, f"^{ADDRESS}", "")).otherwise(found)
        name = F.substring(found, F.lit(1), F.length(found) - F.length(value))
        return F.struct(kind.alias("kind"), value.alias("value"),
                        F.concat(F.regexp_extract(before, CONTEXT, 0), name).alias("context"),
                        F.coalesce(source, F.lit("")).alias("source"))

    none = F.array().cast("array<struct<kind:string,value:string,context:string,source:string>>")
    def each(matches: Column) -> Column:
        # of the pieces between the matches, what stands before each: its own piece
        # after the match before it
        tails = F.transform(F.split(text, CANDIDATE, -1), lambda x: F.right(x, F.lit(BEFORE)))
        earlier = F.concat(F.array(F.lit("")), F.transform(matches, lambda x: F.right(x, F.lit(BEFORE))))
        before = F.zip_with(earlier, tails, lambda e, t: F.right(F.concat(e, t), F.lit(BEFORE)))
        return F.transform(F.arrays_zip(matches.alias("m"), F.slice(before, 1, F.size(matches)).alias("b")),
                           lambda x: part(x["m"], x["b"]))

    # the matches are bound once, as the only element of an array
    found = F.flatten(F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))), each))
    return F.when(text.rlike(CANDIDATE), found).otherwise(none)


def features(c: Column, words: list[str]) -> Column:
    """What the forest sees of a candidate, as an array of doubles."""
    # markup around a name or value is no neighbouring word
    value, context = c["value"], F.regexp_replace(c["context"], "</?[A-Za-z]{1,10}>", "")
    n = F.length(value).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / n

    runs = F.filter(F.split(F.lower(value), "[^a-z]+"), lambda r: F.length(r) >= 3)
    known = F.filter(runs, lambda r: r.isin(words)) if words else F.array().cast("array<string>")
    covered = F.aggregate(known, F.lit(0), lambda a, r: a + F.length(r)) / n

    def flag(x: Column) -> Column:
        return x.cast("double")

    return F.array(
        n,
        # transitions between character classes, and between vowels and other letters
        share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
        share("(?i)[aeiou](?=[^aeiou])"),
        share("(.)(?=\\1)"),
        share("[0-9]"), share("[A-Z]"),
        F.size(F.array_distinct(F.split(value, ""))) / n,
        flag(value.rlike("^[0-9a-fA-F-]+$")),          # a digest, a commit id or a UUID
        covered,
        # path: inside an address or a file path, or in a source that holds examples
        flag(value.rlike("/|\\.[a-z]{2,4}$") | context.rlike("(?:[:/.@]|://\\S*)$")),
        flag(c["source"].rlike(PATH_WORDS)),
        # neighbouring words
        flag(context.rlike(f"(?i)(?:\\b[A-Za-z0-9_]*(?:{NAMES})|(?:\\b|_)(?:key|bearer|auth))\\b")),
        flag(context.rlike("[:=]\\s{0,3}[\"']?$")),
        flag(F.concat(context, value).rlike(PLACEHOLDER)),
        flag(c["kind"].isin("provider key", "private key")),
        flag(c["kind"] == "address"))


def rule_label(c: Column, f: Column) -> Column:
    """Labelling rules: 1 secret, 0 false positive, null undecided."""
    placeholder, provider, address = f[13] == 1, f[14] == 1, f[15] == 1
    return F.when((provider | address) & ~placeholder, 1.0) \
        .when(placeholder | (f[8] >= 0.5) | (f[6] < 0.2), 0.0) \
        .when((c["kind"] == "assigned") & (f[0] >= 12) & (f[4] > 0.1) & (f[4] < 1) & (f[1] > 0.15), 1.0) \
        .when((c["kind"] == "generic") & (f[11] == 0) & ((f[4] == 0) | (f[4] == 1) | (f[7] == 1) | (f[9] == 1)), 0.0)


def seed_findings(spark: SparkSession, words: list[str], n: int = SEED_ROWS) -> DataFrame:
    """Made labelled findings: (kind, value, context, source, label)."""
    words = words or ["ordinary", "running", "letters", "without", "meaning"]
    vocab = F.array(*map(F.lit, words[:512]))
    i = F.col("id")

    def digest(salt: int) -> Column:
        return F.sha2(F.concat_ws(":", F.lit(salt), i.cast("string")), 256)

    def word(salt: int) -> Column:
        return F.element_at(vocab, (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(min(512, len(words)))) + 1).cast("int"))

    mixed = F.regexp_replace(F.base64(F.unhex(digest(1))), "[^A-Za-z0-9]", "")
    name = F.element_at(F.array(*map(F.lit, ("password", "token", "api_key", "secret", "pwd"))),
                        (F.pmod(F.xxhash64(F.lit(9), i), F.lit(5)) + 1).cast("int"))
    sep = F.element_at(F.array(*map(F.lit, ("=", ": ", " = \"", "=\""))), (F.pmod(i, F.lit(4)) + 1).cast("int"))
    assigned = F.concat_ws(" ", word(2), F.concat(name, sep))
    plain = F.concat(word(3), F.lit(" "), word(4), F.lit(" "))
    size = (F.pmod(F.xxhash64(F.lit(5), i), F.lit(28)) + 12).cast("int")
    labels = F.element_at(F.array(*map(F.lit, ("commit ", "sha256:", "checksum: ", "etag ", "id=", "revision "))),
                          (F.pmod(F.xxhash64(F.lit(11), i), F.lit(6)) + 1).cast("int"))
    told = F.when(F.pmod(F.xxhash64(F.lit(12), i), F.lit(3)) > 0, labels).otherwise(plain)
    width = F.element_at(F.array(*map(F.lit, (32, 40, 64))), (F.pmod(F.xxhash64(F.lit(10), i), F.lit(3)) + 1).cast("int"))
    uuid = F.concat_ws("-", *[F.substring(digest(6), at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    keyed = F.concat(word(2), F.element_at(F.array(*map(F.lit, (" key ", " Bearer ", " auth "))),
                                           (F.pmod(F.xxhash64(F.lit(13), i), F.lit(3)) + 1).cast("int")))
    address = F.concat(word(2), F.lit(" postgres://"), word(3), F.lit(":"))
    rows = [
        ("assigned", F.substring(digest(2), F.lit(1), size), assigned, 1.0),
        ("assigned", F.substring(mixed, F.lit(1), size), assigned, 1.0),
        ("provider key", F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), plain, 1.0),
        ("provider key", F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), plain, 1.0),
        ("private key", F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.repeat(F.concat(mixed, F.lit("+/\n")), (F.pmod(i, F.lit(40)) + 1).cast("int")),
                                 F.lit("-----END RSA PRIVATE KEY-----")), plain, 1.0),
        ("address", F.substring(mixed, F.lit(1), F.pmod(size, F.lit(20)) + 6), address, 1.0),
        ("generic", F.substring(mixed, F.lit(1), size + 12), keyed, 1.0),
        ("generic", F.substring(digest(7), F.lit(1), width), told, 0.0),
        ("generic", uuid, told, 0.0),
        ("generic", F.concat(F.lit("sha512-"), F.base64(F.unhex(F.concat(digest(8), digest(9))))), told, 0.0),
        ("assigned", F.concat(word(5), F.lit("_"), word(6)), assigned, 0.0),
        ("assigned", F.concat(F.lit("your_"), name, F.lit("_here")), assigned, 0.0),
        ("assigned", F.concat(word(6), word(7), word(8)), assigned, 0.0),
        ("generic", F.concat_ws("-", word(1), word(2), word(3), word(4), word(5)), plain, 0.0),
        ("generic", F.concat_ws("/", word(1), word(2), word(3), word(4), word(5)), F.concat(plain, F.lit("/")), 0.0),
        ("generic", F.regexp_replace(F.conv(F.substring(digest(3), 1, 15), 16, 10), "^", "9031"), plain, 0.0),
        ("generic", F.repeat(F.substring(digest(4), 1, 1), 24), plain, 0.0),
        ("generic", F.concat(word(1), word(2), word(3), word(4), word(5), word(6)), plain, 0.0),
    ]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value"), c.alias("context"), F.lit("").alias("source"),
                               F.lit(label).alias("label")) for k, v, c, label in rows])
    return spark.range(0, n, 1, 1).select(F.element_at(kinds, (F.pmod(i, F.lit(len(rows))) + 1).cast("int")).alias("f")) \
        .select("f.*").filter("length(value) > 0")


def labelled_findings(docs: DataFrame, words: list[str], text: str = "text", source: str = "source",
                      n: int = TRAIN_ROWS) -> DataFrame:
    """(x array<double>, label): the corpus's distinct candidates that the rules
    decide, a sample of about ``n`` of them by hash if there are more, and the
    made ones."""
    origin = F.col(source) if source in docs.columns else F.lit("")
    found = keep(docs.select(F.explode(candidates(F.col(text), origin)).alias("c")) \
        .select("c.*").groupBy("kind", "value").agg(F.min(F.struct("context", "source")).alias("m")) \
        .select("kind", "value", "m.context", "m.source"), "candidates")
    share = min(1.0, n / max(1, found.count()))
    found = found.filter(F.pmod(F.xxhash64("value", "kind"), F.lit(1 << 30)) < int(share * (1 << 30)))
    c = F.struct("kind", "value", "context", "source")
    made = seed_findings(docs.sparkSession, words).select("kind", features(c, words).alias("x"), "label")
    # written once: the fit reads its rows several times, and the rules, planned over the
    # features' expressions, would hold the dictionary many times over
    seen = keep(found.select("kind", features(c, words).alias("x"), F.lit(None).cast("double").alias("label")).union(made), "labelled")
    return seen.select("x", F.coalesce("label", rule_label(F.struct("kind"), F.col("x"))).alias("label")).filter("label IS NOT NULL")


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """Forest of labelled findings (x, label), the same for any layout of them."""
    rows = labelled.select("x", "label").repartition(1).sortWithinPartitions("x", "label") \
        .select(array_to_vector("x").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=FOREST_SEED, featureSubsetStrategy="sqrt").fit(rows)


def score(model: RandomForestClassificationModel, x: Column) -> Column:
    """Share of the forest's trees that call the feature array a secret."""
    def grow(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(float(node.prediction()))
        at = node.split()
        return F.when(F.element_at(x, at.featureIndex() + 1) <= at.threshold(), grow(node.leftChild())) \
            .otherwise(grow(node.rightChild()))

    votes = [grow(t._call_java("rootNode")) for t in model.trees]
    return sum(votes[1:], votes[0]) / len(votes)


def scan(docs: DataFrame, text: str = "text", source: str = "source", labelled: DataFrame | None = None,
         threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``findings`` (kind, value, score of every candidate) and
    ``secrets`` (the values that the forest keeps, longest first)."""
    words = dictionary(docs, text)
    model = train(labelled if labelled is not None else labelled_findings(docs, words, text, source))
    base = docs.select(*[c for c in docs.columns if c not in ("findings", "secrets")])
    origin = F.col(source) if source in docs.columns else F.lit("")
    found = base.withColumn("findings", candidates(F.col(text), origin))

    def judge(c: Column) -> Column:
        # the features are bound once, as the only element of an array
        return F.element_at(F.transform(F.array(features(c, words)), lambda x: F.struct(
            c["kind"].alias("kind"), c["value"].alias("value"), score(model, x).alias("score"))), 1)

    found = found.withColumn("findings", F.transform("findings", judge))
    secret = F.transform(F.filter("findings", lambda f: f["score"] >= threshold), lambda f: f["value"])
    longest = F.transform(F.array_sort(F.transform(F.array_distinct(secret), lambda v: F.struct(
        (-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])
    return found.withColumn("secrets", longest)


def redacted(text: str = "text") -> Column:
    """The text with every secret found in it masked."""
    return F.aggregate("secrets", F.col(text), lambda t, v: F.replace(t, v, F.lit(MASK)))


def redact(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Pipeline form: ``docs`` with secrets masked in the text."""
    out = scan(docs, text, source).withColumn(text, redacted(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text", "source"))
    kinds = F.transform(F.filter("findings", lambda f: f["score"] >= 0.5), lambda f: f["kind"])
    return found.select(
        "doc_id", F.size("findings").cast("bigint").alias("n_candidates"),
        F.size(kinds).cast("bigint").alias("n_secrets"),
        F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds"),
        F.coalesce(F.array_max(F.transform("findings", lambda f: f["score"])), F.lit(0.0)).alias("score"),
        F.sha2(F.coalesce(redacted(), F.lit("")), 256).alias("redacted_sha256"))
