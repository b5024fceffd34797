"""Operator 2: secret scans; a random forest removes false positives.

Candidates are runs of key characters that a pattern finds in whole texts: long enough, with a digit or
a mixture of cases (both, and not only capitals at the heads of words), the value of an assignment
to a credential's name (a word of its own: ``token`` is one, the head of ``tokens`` is none; a scheme such as ``Bearer``
before the value is no part of it), or the password of a user in an address. Where a value and a run overlap, the value is the candidate, and what stands before
the name is one if it is long enough too; of ``name=value`` with other names the value is, if it is
long enough, else the whole run. Each gets features by built-in functions alone: length,
shares of character classes, changes between classes, vowels, repeated characters, dictionary coverage
(letters of the candidate in runs that are frequent words), path marks, and the words beside it.

The forest (Spark ML, its model applied as a JVM expression) is trained on labelled findings: a table of
``before, candidate, after, label``. Without one, findings are labelled by rules over the
corpus itself, on a bounded sample (``SAMPLE`` a label by hash): known formats of keys, and assignments to names
of credentials with a digit, a mark or a change of case inside, are secrets; candidates in paths or addresses, digits only (card
and account numbers), plain words and words with repeated marks are not. A finding is kept if the forest gives it
``KEEP`` or more. Texts are redacted: each kept secret gives way to ``MARK``.

Defined results: a candidate has no greatest length; a null or empty text has no findings; one place is found once, the same secret
at several places several times; without findings of both labels the rules alone decide; equal rows
give equal findings each; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonekit.llm.common import staged, table

SAMPLE, KEEP, MARK = 2000, 0.5, "[SECRET]"
TREES, DEPTH, SEED = 24, 6, 17

#: Names of credentials, schemes before a value, formats of well-known keys, frequent word parts.
NAMES = (r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credentials?|private[_-]?key)")
SCHEMES = r"(?:bearer|basic|digest|negotiate|apikey)"
FORMATS = (r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}"
           r"|sk[_-](?:live[_-]|test[_-])?[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_.-]{8,})$")
#: A name by itself, or with a part before or behind it that a mark or a capital sets off; then the sign of an assignment.
WHOLE = (r"(?:(?<![A-Za-z])|(?<=[a-z])(?=(?-i:[A-Z])))" + NAMES + r"(?:[_-][A-Za-z_-]{1,20}|(?-i:[A-Z])[A-Za-z]{1,19})?(?![A-Za-z])")
SIGN = r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?:" + SCHEMES + r"\s{1,3})?+[\"']?"
ASSIGNED = "(?i)" + WHOLE + SIGN + "$"
COMMON = ("the and ing tion ent ion her for tha nth int ere ter est ers ati hat ate all eth hes ver his oft ith fth sth oth res "
          "ont que les des ment est pas con los las del ado che sch ein und der die ich cht gen ung ver").split()
#: A candidate: 16 or more key characters with a digit or mixed cases, or 6 or more characters assigned to a credential's
#: name. No upper bounds; possessive or from the head of a run alone, so that time grows with the text alone.
KEY, PLAIN = "[A-Za-z0-9+/=_.-]", "[A-Za-z+/=_.-]"
MIXED = rf"{PLAIN}*+[0-9]|{PLAIN}*?[a-z][A-Z]|(?={PLAIN}*?[A-Z][A-Z]){PLAIN}*?[a-z]"
RUN = rf"(?<!{KEY})(?={KEY}{{16}})(?={MIXED}){KEY}++"
LONG = rf"^(?={KEY}{{16}})(?={MIXED})"
USER = r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@\"'<>]{1,64}:"
VALUE = (r"(?i)(?:" + WHOLE + SIGN + r"(?!" + SCHEMES + r"(?![A-Za-z0-9]))[^\s\"'<>,;\[]{6,}+|" + USER + r"[^\s/@\"'<>]{3,}+@)")
NAME = r"^[A-Za-z_][A-Za-z0-9_.-]*+=$"
#: What stands before the value in a match of ``VALUE``, and the end of an address's part.
LEAD = "(?i)^(?:" + NAMES + r"(?:[_-][A-Za-z_-]{1,20}|(?-i:[A-Z])[A-Za-z]{1,19})?" + SIGN + "|" + USER + ")"
IS_USER = "(?i)^" + USER
BESIDE, FEW_ROWS, MANY_SPOTS, CHUNK = 48, 500_000, 64, 256

_NONE = "array<struct<at:int,candidate:string>>"


def _running(lengths: Column) -> Column:
    """Running sums of an array, by chunks: no step copies more than a chunk or the list of chunks."""
    last = F.greatest(F.ceil(F.size(lengths) / CHUNK).cast("int") - 1, F.lit(0))
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)))
    none = F.array().cast("array<int>")

    def add(acc: Column, x: Column) -> Column:
        upto = acc["sum"] + x
        return F.struct(upto.alias("sum"), F.concat(acc["out"], F.array(upto)).alias("out"))

    zero = F.lit(0).cast("int")
    folded = F.transform(chunks, lambda c: F.aggregate(c, F.struct(zero.alias("sum"), none.alias("out")), add))

    def join(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda v: v + acc["sum"])
        return F.struct((acc["sum"] + x["sum"]).alias("sum"), F.concat(acc["out"], F.array(moved)).alias("out"))

    start = F.struct(zero.alias("sum"), F.array().cast("array<array<int>>").alias("out"))
    return F.flatten(F.aggregate(folded, start, join)["out"])


def _matches(text: Column, pattern: str) -> Column:
    """``at`` (from 1) and ``candidate`` of every match: places are sums of the lengths of what is before."""
    def placed(x: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(x["found"], lambda m: F.length(m)))
        gaps = F.zip_with(F.slice(x["between"], F.lit(1), F.size(x["found"])), F.slice(before, F.lit(1), F.size(x["found"])),
                          lambda t, n: F.length(t) + n)
        return F.zip_with(F.get(F.transform(F.array(gaps), _running), 0), x["found"],
                          lambda at, m: F.struct((at + 1).alias("at"), m.alias("candidate")))
    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.get(F.transform(F.array(both), placed), 0).cast(_NONE)


def _parts(run: Column) -> Column:
    """The run without leading ``name=``, or cut before each part that is a candidate by itself; whole without any."""
    start = F.struct(run["at"].alias("at"), F.array().cast(_NONE).alias("out"))
    pieces = F.split(run["candidate"], "(?<==)(?!=|$)")

    def add(acc: Column, x: Column) -> Column:
        some, last = F.size(acc["out"]) > 0, F.get(acc["out"], F.size(acc["out"]) - 1)
        one = F.array(F.struct(acc["at"].alias("at"), x.alias("candidate")))
        more = F.array(F.struct(last["at"].alias("at"), F.concat(last["candidate"], x).alias("candidate")))
        starts = F.when(some, x.rlike(LONG) & last["candidate"].rlike(LONG)).otherwise(x.rlike(LONG) | ~x.rlike(NAME))
        return F.struct((acc["at"] + F.length(x)).alias("at"),
                        F.when(starts, F.concat(acc["out"], one))
                        .when(some, F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), more))
                        .otherwise(acc["out"]).alias("out"))

    cut = F.aggregate(pieces, start, add)["out"]
    return F.when(run["candidate"].rlike("=[^=]") & F.exists(cut, lambda x: x["candidate"].rlike(LONG)),
                  F.filter(cut, lambda x: x["candidate"].rlike(LONG))).otherwise(F.array(run))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, at, candidate, before, after``: candidates and what stands beside them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.where(F.col("text").rlike(RUN) | F.col("text").rlike(VALUE))
    def value(x: Column) -> Column:
        own = F.regexp_replace(x["candidate"], LEAD, "")
        own = F.struct(own.alias("own"), x["candidate"].rlike(IS_USER).alias("user"))
        return F.get(F.transform(F.array(own), lambda v: F.struct(
            (x["at"] + F.length(x["candidate"]) - F.length(v["own"])).alias("at"),
            F.when(v["user"], F.substring(v["own"], F.lit(1), F.length(v["own"]) - 1)).otherwise(v["own"]).alias("candidate"),
            x["at"].alias("name"))), 0)

    given = F.transform(_matches(F.col("text"), VALUE), value)
    rows = rows.select("doc_id", "text", F.inline(F.array(F.struct(
        _matches(F.col("text"), RUN).alias("runs"), given.alias("given")))))
    # a value goes on to the end of any run that it meets: of such a run only what is before the name is left
    meets = lambda r: F.filter("given", lambda v: (v["at"] < r["at"] + F.length(r["candidate"])) & (
        r["at"] < v["at"] + F.length(v["candidate"])))
    runs = F.transform("runs", lambda r: F.struct(r["at"].alias("at"), F.when(F.size(meets(r)) == 0, r["candidate"]).otherwise(
        F.substring(r["candidate"], F.lit(1), F.greatest(F.get(meets(r), F.lit(0))["name"] - r["at"], F.lit(0)))).alias("candidate")))
    runs = F.filter(runs, lambda r: r["candidate"].rlike(LONG))
    given = F.transform("given", lambda v: F.struct(v["at"].alias("at"), v["candidate"].alias("candidate")))
    rows = rows.select("doc_id", "text", F.inline(F.concat(F.flatten(F.transform(runs, _parts)), given)))
    first = F.greatest(F.col("at") - BESIDE, F.lit(1))
    return rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "at", "candidate",
        F.substring("text", first, F.col("at") - first).alias("before"),
        F.substring("text", F.col("at") + F.length("candidate"), F.lit(BESIDE)).alias("after"))


def _share(pattern: str) -> Column:
    """Share of the candidate's characters that the pattern matches."""
    rest = F.length(F.regexp_replace("candidate", pattern, ""))
    return (F.length("candidate") - rest) / F.length("candidate")


def _changes(classes: str) -> Column:
    """Changes from a class to another, a character."""
    return F.size(F.regexp_extract_all("candidate", F.lit(classes), F.lit(0))) / F.length("candidate")


def features() -> dict[str, Column]:
    """The forest's inputs, of ``candidate``, ``before`` and ``after``."""
    return {
        "length": F.length("candidate").cast("double"), "digits": _share("[0-9]"), "capitals": _share("[A-Z]"),
        "small": _share("[a-z]"), "hex": _share("[0-9a-f]"), "marks": _share("[^A-Za-z0-9]"), "vowels": _share("(?i)[aeiou]"),
        "letter_to_digit": _changes("[A-Za-z](?=[0-9])"), "digit_to_letter": _changes("[0-9](?=[A-Za-z])"),
        "case_changes": _changes("[a-z](?=[A-Z])|[A-Z](?=[a-z])"), "repeats": _changes(r"(.)(?=\1)"),
        "dictionary": _share("(?i)(?:" + "|".join(COMMON) + ")"), "path_marks": _share(r"[/.]"),
        "path_before": F.col("before").rlike(r"(?:://|/|\\\\|@)[^\s]*$").cast("double"),
        "assigned": F.col("before").rlike(r"[=:]\s{0,3}[\"']?$").cast("double"),
        "user": F.col("before").rlike("(?i)" + USER + "$").cast("double"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "credential_word": F.col("before").rlike("(?i)" + NAMES).cast("double"),
        "common_before": F.col("before").rlike("(?i)(?:" + "|".join(COMMON) + r")\w*\W*$").cast("double"),
    }


def rule_label() -> Column:
    """Label of a finding by fixed rules: 1 a secret, 0 none, null unsure."""
    return (F.when(F.col("candidate").rlike(FORMATS), 1)
            .when(F.col("candidate").rlike(r"^[0-9.+/=_-]+$") | F.col("candidate").rlike(r"\.\.|//|--|__|==.|^(.)\1{5}"), 0)
            .when(F.col("before").rlike("(?i)" + USER + "$"), 1)
            .when(F.col("candidate").rlike("^[A-Z]?[a-z]+[.!?:]*$"), 0)
            .when(F.col("before").rlike(ASSIGNED), 1)
            .when(F.col("before").rlike(r"(?:://|/|@)[^\s]*$"), 0))


def train(labelled: DataFrame):
    """A forest from labelled findings (``candidate, before, after, label``); None without both labels."""
    rows = labelled.where("label IN (0, 1)")
    key = F.xxhash64("candidate", "before", "after")
    some = [rows.where(F.col("label") == y).orderBy(key).limit(SAMPLE) for y in (0, 1)]  # bounded
    sample = some[0].union(some[1]).select(F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in features().items()])
    sample = staged(sample.coalesce(1), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="p",
                                    predictionCol="forest_says", rawPredictionCol="votes")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features()), outputCol="features"), forest]).fit(sample.coalesce(1))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, at, candidate, score, kept``: every candidate of every text."""
    found = staged(findings(docs, id_col, text_col).withColumn("rule", rule_label()), "findings")
    forest = train(labelled if labelled is not None else found.withColumnRenamed("rule", "label"))
    if forest is None:
        score = F.coalesce(F.col("rule"), F.lit(0)).cast("double")
        rows = found.withColumn("score", score)
    else:
        rows = forest.transform(found.select("*", *[c.alias(n) for n, c in features().items()]))
        rows = rows.withColumn("score", F.round(F.element_at(vector_to_array("p"), 2), 6))
    return rows.select("doc_id", "text_hash", "at", "candidate", "score", (F.col("score") >= KEEP).alias("kept"))


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with each kept secret replaced in ``text``, and ``n_chars`` to match where there is one."""
    kept = scan(docs, labelled).where("kept")
    spots = kept.select("doc_id", "text_hash", "at", F.length("candidate").alias("n")).distinct()
    lists = spots.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.sort_array(F.collect_list(F.struct("at", "n")), asc=False).alias("_spots"))  # of one text
    lists = staged(lists, "spots")
    lists = F.broadcast(lists) if lists.count() <= FEW_ROWS else lists
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # own names meet no others
    rows = rows.join(lists, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (
        F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))) == F.col("_hash")), "left")
    text, hit = F.col("row.text"), F.col("_spots").isNotNull()

    def rebuilt(cut) -> Column:
        """What is between the spots, joined by marks; ``cut(from, length)`` gives a part of the text."""
        spots = F.sort_array(F.transform("_spots", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"))))
        starts = F.concat(F.array(F.lit(1)), F.transform(spots, lambda s: s["at"] + s["n"]))
        stops = F.concat(F.transform(spots, lambda s: s["at"]), F.array(F.length(text) + 1))
        return F.array_join(F.zip_with(starts, stops, lambda a, b: cut(a, F.greatest(b - a, F.lit(0)))), MARK)

    def by_characters(chars: Column) -> Column:
        return rebuilt(lambda a, n: F.array_join(F.slice(chars, a, n), ""))

    few = rebuilt(lambda a, n: F.substring(text, a, n))  # each part is counted from the text's head
    many = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), by_characters), 0)
    clean = F.when(~hit, text).when(F.size("_spots") <= MANY_SPOTS, few).otherwise(many)
    rows = rows.select("row", hit.alias("hit"), clean.alias("clean"))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("hit"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents with the forest's score and verdict."""
    return scan(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES: dict[str, str] = {}
