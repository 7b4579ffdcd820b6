"""Secret scanning with DataFrame and SQL functions only.

A regular expression finds candidates: runs of 16 and more key characters with a
digit, issued keys by their prefix, values that are assigned to a telling name and
passwords before the host of a URL.  Each candidate
gets features (length, character transitions, entropy, dictionary coverage,
path, neighbouring words) and a random forest removes the false positives.  The
forest is fitted on labelled findings: `labelled_findings` writes PER_CASE
findings for each documented case of secret and of look-alike, a bound that does
not depend on the corpus.  Everything runs in the JVM: no Python worker starts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import as_table, fresh, with_row

#: Labelled findings per case; trees, depth and seed of the forest; score from which a candidate is a secret.
PER_CASE = 120
TREES, DEPTH, SEED = 24, 7, 11
THRESHOLD = 0.5
#: Characters before and after a candidate that its features may see.
AROUND = 48
MARK = "[SECRET]"

_NAMES = r"password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?|bearer"
_KEY = r"A-Za-z0-9+/_\-"
_ISSUED = r"AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk_live_|sk-|rk_live_|xox[abprs]-|eyJ|SG\.|ya29\."
_GAP = r"[ \t]{0,8}"
#: An issued key, a run of key characters with a digit, the password of ``://user:password@host``, or a value behind a telling name.
CANDIDATE = (
    rf"(?<![{_KEY}])(?:{_ISSUED})[{_KEY}]{{12,}}+={{0,2}}"
    rf"|(?<![{_KEY}])(?=[A-Za-z+/_\-]*+[0-9])[{_KEY}]{{16,}}+={{0,2}}"
    r"|(?<=:)(?<=://[^\s/:@\"'<>]{0,64}:)[^\s@/\"'<>]++(?=@)"
    # The short looks behind spare most places the long one.
    rf"|(?<=[=:>\"'` \t])(?<=[=:>]{_GAP}[\"'`]?)(?<=(?i:{_NAMES})[\"'`]?{_GAP}(?:=>|[=:]{{1,2}}){_GAP}[\"'`]?)[^\s\"'`,;<>]{{8,}}+"
    r"|(?<=[rR][ \t]{1,8})(?<=(?i:bearer)[ \t]{1,8})[^\s\"'`,;<>]{8,}+"
)
#: Words of names, paths and placeholders.
DICTIONARY = (
    "password|example|sample|placeholder|changeme|secret|token|test|demo|dummy|your|here|insert|none|null|admin|user|name|value|default|config|"
    "index|module|package|python|java|script|style|image|table|column|document|article|section|chapter|version|release|update|service|server|"
    "client|data|file|path|home|local|share|library|function|class|method|object|string|number|the|and|for|with|from|this|that|not|are|was|tion|ing|ment"
)
_NEAR = rf"(?i)(?:{_NAMES})[\"']?\s*(?:[=:]+|is)?\s*[\"'`]?$"
_IDENTIFIER = r"(?i)(?:commit|sha-?\d*|md5|hash|digest|checksum|etag|uuid|guid|revision|build|version|isbn|issn|order|invoice|card|phone|tel|number|ticket|ref)[\w ]{0,12}[=:#]?\s*[\"'`(]?$"
_PREFIX = rf"^(?:{_ISSUED})"

FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "transitions", "distinct", "entropy", "hex_only", "digits_only",
    "dictionary", "slashes", "hyphens", "in_path", "in_url", "doc_path", "named", "identifier", "quoted", "prefix", "userinfo",
]


def _count(s: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(s, f"[^{pattern}]", ""))


def features(found: DataFrame, secret: str = "secret", left: str = "left", right: str = "right", path: str = "path") -> DataFrame:
    """Adds FEATURES as doubles to rows that have a candidate, its neighbourhood and the path of its document."""
    s, before, after = F.col(secret), F.col(left), F.col(right)
    n = F.length(s)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-")
    chars = F.array_distinct(F.split(s, ""))
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    flag = lambda c: c.cast("double")
    own = {
        "length": F.least(n, F.lit(200)),
        "digits": _count(s, "0-9") / n,
        "uppers": _count(s, "A-Z") / n,
        "lowers": _count(s, "a-z") / n,
        "others": 1 - _count(s, "A-Za-z0-9") / n,
        "transitions": (F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) - 1) / n,
        "distinct": F.size(chars) / n,
        "entropy": F.aggregate(chars, F.lit(0.0), lambda acc, c: F.when(F.length(c) > 0, acc - share(c) * F.log2(share(c))).otherwise(acc)),
        "hex_only": flag(s.rlike("^[0-9a-fA-F]+$")),
        "digits_only": flag(s.rlike("^[0-9-]+$")),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(s), DICTIONARY, "")) / n,
        "slashes": _count(s, "/") / n,
        "hyphens": _count(s, "_-") / n,
        "in_path": flag(before.rlike(r"[/\\.~]$") | s.rlike("^/|(?:/[a-z]+){2}") | after.rlike(r"^(?:/|\.[a-z]{2,4}\b)")),
        "in_url": flag(before.rlike(r"(?:https?://|www\.|base64,)\S*$")),
        "doc_path": flag(F.coalesce(F.col(path), F.lit("")).rlike("(?i)test|example|sample|fixture|mock")),
        "named": flag(before.rlike(_NEAR)),
        "identifier": flag(before.rlike(_IDENTIFIER)),
        "quoted": flag(before.rlike("[\"'`=:]$")),
        "prefix": flag(s.rlike(_PREFIX)),
        "userinfo": flag(before.rlike(r"://[^\s/:@]*:$") & after.startswith("@")),
    }
    return found.withColumns({k: v.cast("double") for k, v in own.items()})


def labelled_findings(spark: SparkSession) -> DataFrame:
    """Labelled findings (secret, left, right, path, label, case), PER_CASE of each case, made from digests of running numbers."""
    d = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512)
    b64 = lambda salt, n: F.substring(F.regexp_replace(F.base64(F.unhex(d(salt))), "[^A-Za-z0-9]", "x"), 1, n)
    hexa = lambda salt, n: F.substring(d(salt), 1, n)
    digits = lambda salt, n: F.substring(F.translate(d(salt), "abcdef", "183957"), 1, n)
    words = F.split(F.lit("the report index service module north river update sample article release council number market window"), " ")
    word = lambda salt: F.element_at(words, (F.conv(hexa(salt, 2), 16, 10).cast("int") % 15 + 1))
    caps = lambda salt, n: F.substring(F.upper(F.regexp_replace(F.base64(F.unhex(d(salt))), "[^A-Za-z0-9]", "7")), 1, n)
    say = lambda *x: F.concat(*(y if isinstance(y, Column) else F.lit(y) for y in x))
    names = F.split(F.lit("password passwd secret token api_key access_key auth credential"), " ")
    name = F.element_at(names, (F.col("id") % 8 + 1).cast("int"))
    seps = F.split(F.lit('=|: |= | = "|": "|: "|:'), "[|]")
    sep = F.element_at(seps, (F.col("id") % 7 + 1).cast("int"))
    telling = F.split(F.lit("password db_password api-key access_key passphrase private_key secret credentials auth token pwd"), " ")
    told = say(F.element_at(telling, (F.col("id") % 11 + 1).cast("int")), sep)
    letters = lambda salt, n: F.translate(b64(salt, n), "0123456789", "qWeRtYuIoP")
    plain = F.element_at(F.split(F.lit("required forgotten information something protected whatever available necessary invalid! expired-now"), " "), (F.col("id") % 10 + 1).cast("int"))
    code = F.element_at(F.split(F.lit("${PASSWORD} os.environ[ getToken() self.password config.get( {{secret}} ******** process.env.TOKEN"), " "), (F.col("id") % 8 + 1).cast("int"))
    scheme = F.element_at(F.split(F.lit("postgres:// https:// mysql:// redis:// amqp://"), " "), (F.col("id") % 5 + 1).cast("int"))
    varied = F.substring(d("v"), 1, (16 + F.col("id") % 33).cast("int"))
    # Short passwords that a test would hold as well count outside tests only.
    program = F.element_at(F.split(F.lit("|src/app/main.py|conf/app.ini|web"), "[|]"), (F.col("id") % 4 + 1).cast("int"))
    tested = F.element_at(F.split(F.lit("tests/fixtures/settings.py|docs/example.md|sample.env"), "[|]"), (F.col("id") % 3 + 1).cast("int"))
    cases = [
        # secrets
        (1, say("AKIA", caps("a", 16)), say(word("l"), " ", word("m"), " "), say(" ", word("r"))),
        (1, say("AKIA", caps("b", 16)), say("aws_access_key_id = "), say("")),
        (1, varied, say(word("l"), " ", name, ' = "'), say('" ', word("r"))),
        (1, varied, say(word("l"), " ", name, "="), say(" ", word("r"))),
        (1, b64("c", 24), say(name, ": "), say("")),
        (1, b64("d", 40), say(word("l"), " ", name, ' = "'), say('"')),
        (1, say("ghp_", b64("e", 36)), say(word("l"), " "), say(" ", word("r"))),
        (1, say("sk_live_", b64("f", 24)), say("key "), say(".")),
        (1, say("xoxb-", digits("g", 11), "-", b64("g", 24)), say(word("l"), " "), say("")),
        (1, say("eyJ", b64("h", 60)), say("Authorization: Bearer "), say("")),
        (1, say("AIza", b64("i", 35)), say(word("l"), " "), say("")),
        (1, say("ghp_", letters("i", 36)), say(word("l"), " "), say(" ", word("r"))),
        (1, say(F.initcap(word("a")), digits("b", 2), F.initcap(word("c")), "!"), told, say(""), program),
        (1, say(F.substring(letters("j", 9), 1, 4), digits("k", 1), F.lower(letters("l", 8))), told, say(" ", word("r")), program),
        (1, say(word("a"), digits("m", 1), word("c")), told, say(""), program),
        (1, F.substring(b64("n", 12), 1, (10 + F.col("id") % 3).cast("int")), told, say(""), program),
        (1, F.substring(b64("o", 12), 1, (10 + F.col("id") % 3).cast("int")), say(word("l"), " Bearer "), say("")),
        (1, b64("p", 10), say(scheme, word("u"), ":"), say("@", word("h"), ".org")),
        (1, say(word("a"), digits("q", 2), word("c")), say(scheme, word("u"), ":"), say("@", word("h"))),
        (1, say("p", digits("r", 1), "ssw", digits("s", 1), "rd"), say(scheme, "u:"), say("@h/db")),
        # look-alikes
        (0, plain, told, say(" ", word("r"))),
        (0, code, told, say("")),
        (0, plain, say("the bearer "), say(" ", word("r"))),
        (0, hexa("j", 40), say("commit "), say(" ", word("r"))),
        (0, hexa("k", 32), say("md5: "), say("")),
        (0, hexa("l", 64), say("sha256 checksum "), say("")),
        (0, say(hexa("m", 8), "-", hexa("n", 4), "-", hexa("o", 4), "-", hexa("p", 4), "-", hexa("q", 12)), say("uuid "), say("")),
        (0, digits("r", 16), say(word("l"), " ", word("m"), " "), say(" ", word("r"))),
        (0, say(digits("s", 4), "-", digits("t", 4), "-", digits("u", 4), "-", digits("v", 4)), say("card "), say("")),
        (0, say(digits("w", 3), "-", digits("x", 3), "-", digits("y", 4), "-", digits("z", 6)), say("+1 "), say("")),
        (0, say("/usr/lib/", word("a"), "3/", word("b"), "/", word("c")), say(word("l"), " "), say("")),
        (0, say(word("a"), "/", word("b"), "/", word("c"), "-2024"), say("https://example.com/"), say("")),
        (0, say(word("a"), "_", word("b"), "_", word("c"), "_", digits("d", 2)), say(word("l"), " "), say(" ", word("r"))),
        (0, say(word("a"), "-", word("b"), "-19-", word("c")), say("a "), say(" ", word("r"))),
        (0, say(F.initcap(word("a")), F.initcap(word("b")), F.initcap(word("c")), "V2"), say("class "), say("(")),
        (0, say("your-", name, "-here-123"), say(name, ' = "'), say('"')),
        (0, say("changeme-", word("a"), "-1234567"), say("password="), say("")),
        (0, say("xxxxxxxxxxxxxxx", digits("e", 1)), say("token = \""), say('"')),
        (0, b64("f", 60), say("data:image/png;base64,"), say("")),
        (0, say(word("a"), word("b"), word("c"), digits("g", 1)), say(word("l"), " "), say(" ", word("r"))),
        (0, say(digits("h", 4), "-", digits("i", 2), "-", digits("j", 2), "T", digits("k", 6), "-0000"), say("at "), say("")),
        # values that only the path tells: secrets in a program, look-alikes in its tests
        (1, say("dev", digits("x", 2), word("y")), told, say(""), F.lit("src/app/settings.py")),
        (0, say("dev", digits("x", 2), word("y")), told, say(""), tested),
        (0, say(F.initcap(word("a")), digits("b", 2), F.initcap(word("c")), "!"), told, say(""), tested),
        (0, say(F.substring(letters("j", 9), 1, 4), digits("k", 1), F.lower(letters("l", 8))), told, say(" ", word("r")), tested),
        (0, say(word("a"), digits("m", 1), word("c")), told, say(""), tested),
        (0, F.substring(b64("n", 12), 1, (10 + F.col("id") % 3).cast("int")), told, say(""), tested),
    ]
    # All other cases are met under any path.
    paths = F.element_at(F.split(F.lit("|src/app/main.py|tests/test_app.py|web"), "[|]"), (F.col("id") % 4 + 1).cast("int"))
    out = None
    for k, (label, secret, left, right, *path) in enumerate(cases):
        part = spark.range(PER_CASE).select(
            secret.alias("secret"), left.alias("left"), right.alias("right"), (path[0] if path else paths).alias("path"), F.lit(label).cast("double").alias("label"), F.lit(k).alias("case"), "id"
        )
        out = part if out is None else out.union(part)
    return out.coalesce(1)


def fit(spark: SparkSession, labelled: DataFrame | None = None) -> PipelineModel:
    """The forest, fitted on labelled findings (by default the built-in cases)."""
    # Stored, as the fit reads its rows several times.
    rows = as_table(features(labelled if labelled is not None else labelled_findings(spark)), "labelled_findings")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_guess"
    )
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def candidates(docs: DataFrame, keep: list[str], text_col: str, path: Column) -> DataFrame:
    """Every candidate with its place (code points, end exclusive) and neighbourhood.

    Also its number in the text (``pos``), the text ``before`` it since the candidate before, and behind the last one the
    ``rest``.  Places are running sums over a text's candidates, so a text of many takes time in proportion."""
    hit = docs.where(F.col(text_col).rlike(CANDIDATE)).select(
        *keep, path.alias("path"), F.monotonically_increasing_id().alias("_of"), F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0)).alias("_found"), F.split(text_col, CANDIDATE, -1).alias("_rest")
    )
    piece = F.transform("_found", lambda s, i: F.struct(s.alias("secret"), F.element_at("_rest", i + 1).alias("before"), F.element_at("_rest", i + 2).alias("after")))
    x = hit.select(*keep, "path", "_of", F.size("_found").alias("_n"), F.posexplode(piece).alias("pos", "_one")).select(*keep, "path", "_of", "_n", "pos", "_one.*")
    # The piece behind a candidate is the next one's ``before``; only the last one's is kept whole.
    x = x.withColumns({"rest": F.when(F.col("pos") + 1 == F.col("_n"), F.col("after")), "right": F.left("after", F.lit(AROUND)), "left": F.right("before", F.lit(AROUND))}).drop("after")
    past = Window.partitionBy("_of").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("before") + F.length("secret")).over(past).cast("int")
    x = x.withColumn("end", end).withColumn("start", F.col("end") - F.length("secret"))
    return x.select(*keep, "path", "start", "end", "secret", "left", "right", "pos", "before", "rest")


def judged(docs: DataFrame, keep: list[str], text_col: str, path: Column, model: PipelineModel) -> DataFrame:
    """The candidates with the forest's ``score``: keep, pos, start, end, secret, before, rest."""
    scored = model.transform(features(candidates(docs, keep, text_col, path)))
    return scored.withColumn("score", vector_to_array("_p")[1]).select(*keep, "pos", "start", "end", "secret", "before", "rest", "score")


def _path(docs: DataFrame, path_col: str | None) -> Column:
    return F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", model: PipelineModel | None = None) -> DataFrame:
    """One row per secret: the document's id, ``start`` and ``end`` (code points), ``rule``, ``secret_sha256``, ``score``.

    Null and empty texts have no findings; a null path counts as empty; repeated
    rows report each time; other columns are not read; texts are scanned whole.
    Only candidates are shuffled, to add up their places."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _path(docs, path_col).alias("_path"))
    found = judged(own, ["_id"], "_text", F.col("_path"), model or fit(docs.sparkSession)).where(F.col("score") >= THRESHOLD)
    rule = F.when(F.col("secret").rlike(_PREFIX), "issued_key").when(F.col("secret").rlike("^[0-9a-fA-F]+$"), "hex_value").otherwise("opaque_value")
    return found.select(F.col("_id").alias(id_col), "start", "end", rule.alias("rule"), F.sha2("secret", 256).alias("secret_sha256"), "score")


def redact(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", chars_col: str = "n_chars", model: PipelineModel | None = None) -> DataFrame:
    """The documents with every secret replaced by MARK; the columns stay, ``chars_col`` of a changed text is counted anew where it is there.

    The texts are searched once, for the candidates; these are stored, and documents with a secret are put together anew
    from their pieces.  Equal rows stay apart by their place in the table.  ``docs`` is a stored table."""
    row, of, new = fresh(docs, "row", "of", "new")
    numbered = with_row(docs, row)
    own = numbered.select(F.col(row).alias("_row"), F.col(text_col).alias("_text"), _path(docs, path_col).alias("_path"))
    found = as_table(judged(own, ["_row"], "_text", F.col("_path"), model or fit(docs.sparkSession)), "secret_candidates")
    secret = F.col("score") >= THRESHOLD
    shown = F.struct("pos", F.concat("before", F.when(secret, F.lit(MARK)).otherwise(F.col("secret"))).alias("piece"))
    pieces = found.groupBy("_row").agg(F.max(secret.cast("int")).alias("_any"), F.array_sort(F.collect_list(shown)).alias("_pieces"), F.max("rest").alias("_rest"))
    anew = pieces.where("_any = 1").select(F.col("_row").alias(of), F.concat(F.array_join(F.transform("_pieces", lambda p: p["piece"]), ""), "_rest").alias(new))
    held = numbered.join(anew, F.col(row) == F.col(of), "left").withColumn(text_col, F.coalesce(new, text_col))
    if chars_col in docs.columns:
        changed = F.length(text_col).cast(docs.schema[chars_col].dataType)
        held = held.withColumn(chars_col, F.when(F.col(of).isNotNull(), changed).otherwise(F.col(chars_col)))
    return held.select(*docs.columns)
