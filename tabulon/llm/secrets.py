"""Operator 8: secret scans whose false positives a random forest removes.

DataFrame functions and Spark ML only. Candidates come from one pattern; the forest knows a candidate by its length,
how its characters change, how much of it a dictionary covers, whether it stands in a path, and the words beside it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import cut_lineage, new_path
from tabulon.operators.modelstore import reread

#: Findings that the forest is trained on at most, chosen by hash.
TRAINING_FINDINGS = 20_000
TREES, DEPTH, SEED = 24, 6, 11
#: Probability from which a candidate is taken as a secret.
AT_LEAST = 0.5
#: Characters on either side of a candidate that its context features see.
LEFT, RIGHT = 48, 32

#: Names of secrets before a value, and words that speak against one.
NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "bearer", "credential")
INNOCENT = (
    "example", "sample", "dummy", "test", "placeholder", "changeme", "commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid",
    "order", "invoice", "phone", "tel", "fax", "isbn", "issn", "doi", "card", "account", "iban", "version", "page", "serial", "number",
)
#: Words that names of files, functions and products are made of; random secrets hold few of them.
DICTIONARY = (
    "access", "account", "action", "address", "admin", "agent", "amount", "application", "archive", "article", "asset", "author", "backup", "block",
    "branch", "build", "button", "cache", "category", "change", "channel", "check", "class", "client", "cloud", "code", "column", "comment", "config",
    "content", "control", "copy", "count", "create", "data", "date", "debug", "default", "delete", "detail", "device", "document", "download", "email",
    "error", "event", "example", "export", "field", "file", "filter", "folder", "font", "format", "function", "group", "handler", "header", "html",
    "http", "image", "import", "index", "input", "item", "json", "label", "language", "layer", "license", "line", "link", "list", "local", "login",
    "mail", "main", "manager", "media", "message", "method", "model", "module", "month", "name", "network", "number", "object", "office", "option",
    "order", "output", "page", "param", "parent", "path", "photo", "picture", "plugin", "product", "profile", "project", "public", "query", "record",
    "remote", "report", "request", "resource", "response", "result", "route", "sample", "schema", "script", "search", "section", "select", "server",
    "service", "session", "setting", "source", "start", "state", "static", "status", "store", "string", "style", "system", "table", "target", "task",
    "template", "test", "text", "theme", "time", "title", "token", "type", "update", "upload", "user", "value", "version", "video", "view", "widget", "window",
)

_NAMED = "(?i:" + "|".join(NAMES) + ")"
#: A run of 16 and more letters, digits and + / _ - with a digit in it, or any value of 6 and more after a name of a secret.
CANDIDATE = (
    # the first look back only spares most places the second, which it follows from
    rf"(?<=[:=][ \t]{{0,3}}[\"']?)(?<=(?:{_NAMED})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?)[^\s\"'<>,;]{{6,}}"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
)
#: Cheap test that spares most texts the pattern above.
MAYBE = rf"[0-9]|{_NAMED}"
SHAPES = {
    "key_id": r"^(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}$",
    "vendor": r"^(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35})$",
    "jwt": r"^eyJ[A-Za-z0-9_-]{10,}",
}
FEATURES = (
    "length", "digits", "uppers", "lowers", "signs", "changes", "distinct", "hex", "dictionary", "vowels", "in_path", "named", "innocent", "assigned", "known_shape",
)


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """content, ordinal (from 0), finding, left, right: each candidate of each different text.

    ``content`` is the text's SHA-256: equal texts have equal findings, so they are looked at once. Texts are searched
    whole; ``left`` and ``right`` are what stands next to a candidate, up to the candidates beside it.
    """
    col = df[text].cast("string")
    some = df.where(col.rlike(MAYBE)).select(col.alias("text"))
    named = some.select(F.sha2(F.col("text").cast("binary"), 256).alias("content"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("gaps"))
    near = F.transform("gaps", lambda g: F.struct(F.right(g, F.lit(LEFT)).alias("left"), F.left(g, F.lit(RIGHT)).alias("right")))
    kept = named.where(F.size("found") > 0).select("content", "found", near.alias("near"))
    each = kept.select("content", "near", F.posexplode("found").alias("ordinal", "finding"))
    rows = each.select("content", "ordinal", "finding", F.col("near")[F.col("ordinal")]["left"].alias("left"), F.col("near")[F.col("ordinal") + 1]["right"].alias("right"))
    return rows.groupBy("content", "ordinal").agg(*[F.min(c).alias(c) for c in ("finding", "left", "right")])


def share(col: Column, letters: str) -> Column:
    """Share of the characters that the class ``letters`` has."""
    return F.length(F.regexp_replace(col, f"[^{letters}]", "")) / F.length(col)


def with_features(rows: DataFrame) -> DataFrame:
    """Adds ``FEATURES`` to findings."""
    f, left, right = F.col("finding"), F.lower("left"), F.lower("right")
    changes = F.length(F.regexp_replace(F.regexp_replace(f, r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])", "\u0001"), "[^\u0001]", ""))
    covered = F.length(F.regexp_replace(F.lower(f), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    number = lambda c: c.cast("double")
    made = {
        "length": F.least(F.length(f), F.lit(256)), "digits": share(f, "0-9"), "uppers": share(f, "A-Z"), "lowers": share(f, "a-z"),
        "signs": 1 - share(f, "A-Za-z0-9"), "changes": changes / F.length(f),
        "distinct": F.size(F.array_distinct(F.split(F.substring(f, 1, 256), ""))) / F.least(F.length(f), F.lit(256)),
        "hex": f.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "dictionary": 1 - covered / F.length(f), "vowels": share(F.lower(f), "aeiou"),
        "in_path": left.rlike(r"[/\\.@]$|://\S*$|www\.\S*$") | f.rlike("^/|/.*/") | right.rlike(r"^[/\\@]|^\.[a-z]{2,4}\b"),
        # a name may end a longer one (accessToken); an innocent word speaks of the value only directly before it
        "named": left.rlike("(?:" + "|".join(NAMES) + ")(?:[^a-z]|$)"), "innocent": left.rlike("(?:^|[^a-z])(?:" + "|".join(INNOCENT) + ")[^a-z0-9]{0,4}$"),
        "assigned": left.rlike(r"[:=][ \t]*[\"']?$"), "known_shape": f.rlike("|".join(SHAPES.values())),
    }
    return rows.select("*", *[number(made[n]).alias(n) for n in FEATURES])


def rule_labels(rows: DataFrame) -> DataFrame:
    """Labels findings by the strictest rules of each kind; those between stay unlabelled and out of training.

    Right: vendor formats, and values assigned to a name of a secret that mix letters and digits. Wrong: numbers, plain
    words, findings directly behind innocent words, and hex or mixed runs that nothing names or assigns. A value that is
    both assigned to a name of a secret and behind an innocent word stays unlabelled.
    """
    f = F.col("finding")
    vendor = F.col("known_shape") == 1
    value = (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0) & (F.col("digits") < 1) & (F.col("innocent") == 0) & (F.col("dictionary") < 0.5) & (F.length(f) >= 8)
    number = f.rlike(r"^[0-9+/_.-]+$") & (F.col("named") == 0)
    beside = (F.col("innocent") == 1) & (F.col("known_shape") == 0) & ~((F.col("named") == 1) & (F.col("assigned") == 1))
    bare = (F.col("named") == 0) & (F.col("assigned") == 0) & (F.col("known_shape") == 0)
    placeholder = f.rlike(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|%.*%|null|none|true|false|changeme|your.*)$")
    return rows.withColumn("label", F.when(placeholder, 0).when(vendor, 1).when(value, 1).when(number | beside | bare, 0))


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled findings, by hash, so that reruns train alike."""
    return rows.where("label is not null").orderBy(F.xxhash64("content", "ordinal"), "content", "ordinal").limit(most)


def train(findings: DataFrame, most: int = TRAINING_FINDINGS) -> RandomForestClassificationModel | float:
    """A forest from findings with ``FEATURES`` and ``label`` (1 secret, 0 not); without both labels the constant one.

    It is written and read again, since a fitted model brings along the session, which tasks may not be able to take.
    """
    rows = cut_lineage(sampled(findings, most).select(*FEATURES, F.col("label").cast("double")).coalesce(4))
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.0
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    model = forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows))
    return reread(model, new_path(findings.sparkSession, "finding-forest"))


def scored(rows: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """Adds score and is_secret."""
    if isinstance(model, float):
        out = rows.withColumn("score", F.lit(model))
    else:
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows)
        out = model.transform(ready).withColumn("score", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")
    return out.withColumn("is_secret", F.col("score") >= AT_LEAST)


def found_secrets(df: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """content, ordinal, finding, ``FEATURES``, score, is_secret of each different text.

    ``labelled`` are findings with ``FEATURES`` and label that people have judged; by default the rules of
    ``rule_labels`` label the corpus's own findings.
    """
    rows = cut_lineage(with_features(candidates(df, text)))
    return scored(rows, train(rule_labels(rows) if labelled is None else labelled))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """key, ordinal, finding, score, is_secret: every candidate in every document, in order of place.

    Null and empty texts have no findings; null and repeated keys and repeated texts have theirs each. A table without
    candidates gives no rows.
    """
    rows = found_secrets(df, text, labelled).select("content", "ordinal", "finding", "score", "is_secret")
    col = df[text].cast("string")
    owners = df.where(col.rlike(MAYBE)).select(df[key].alias("doc_id"), F.sha2(col.cast("binary"), 256).alias("content"))
    return owners.join(rows, "content").select(F.col("doc_id").alias(key), "ordinal", "finding", "score", "is_secret")


def redacted(df: DataFrame, text: str = "text", mask: str = "[SECRET]", labelled: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` with each secret in ``text`` replaced by ``mask``; all else stays as it is.

    Only texts with secrets are shuffled, to meet their decisions.
    """
    rows = found_secrets(df, text, labelled)
    secret = rows.where("is_secret").groupBy("content").agg(F.sort_array(F.collect_list("ordinal")).alias("ordinals"))
    secret = cut_lineage(secret)
    name = "content"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    col = F.col(text).cast("string")
    maybe = F.coalesce(col.rlike(MAYBE) & col.rlike(CANDIDATE), F.lit(False))
    inside = df.where(maybe).withColumn(name, F.sha2(col.cast("binary"), 256))
    marked = inside.join(secret.select(F.col("content").alias(name), F.col("ordinals").alias(f"{name}_o")), name, "left")
    found = F.regexp_extract_all(col, F.lit(CANDIDATE), F.lit(0))
    gaps = F.split(col, CANDIDATE, -1)
    parts = F.transform(found, lambda x, i: F.concat(F.when(F.array_contains(F.col(f"{name}_o"), i), F.lit(mask)).otherwise(x), gaps[i + 1]))
    text_now = F.when(F.col(f"{name}_o").isNull(), F.col(text)).otherwise(F.concat(gaps[0], F.array_join(parts, "")))
    changed = marked.withColumn(text, text_now).select(*[F.col(f"`{c}`") for c in df.columns])
    return df.where(~maybe).unionByName(changed)
