"""Secret scans with an incremental blob ledger. Main path: DataFrame functions only.

Every text version is a blob, addressed by the sha256 of its bytes. The ledger is a folder of Parquet tables: `ledger` says which
(blob, rule, version) pairs were scanned, `findings` what was found. A scan reads the ledger, takes the pairs that it lacks,
scans each of those blobs once, whatever the number of rows that hold it, and appends findings and pairs; results are
read from the folder and joined back to every path (key) that holds the blob. A rule is a Java pattern, the least length of a
group, and a version; a changed rule gets a new version and is scanned anew, old findings stay under theirs.

Spans are code points, end exclusive: a text split at the matches gives the gaps between them; running sums over gaps
and matches, by blob and rule, are the positions. So the work is linear in the matches, in texts of any length. A text that
lacks a rule's fixed part is not tried further. Null text is the empty blob, without findings. Repeated rows are paths of the
same blob. Rows of null key are paths too. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.llm.common import shared_dir, stash, text_of


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and without overlap, whose group `group` has `least` characters or more. `needs`: texts without
    any of these strings hold no match; empty: every text is tried."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1
    needs: tuple[str, ...] = ()


#: fixed values: the base rules and the rules that this operator adds
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, needs=(":", "=")),
    Rule("access", r"AKIA[A-Z0-9]+", 16, needs=("AKIA",)),
    Rule("hex", r"[0-9a-f]+", 32),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?", 0, needs=("-----BEGIN ",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, needs=("eyJ",)),
    Rule("forge", r"(?:ghp|gho|ghs|ghr|glpat|xox[bap])[_-][A-Za-z0-9_-]{20,}", 0, needs=("ghp", "gho", "ghs", "ghr", "glpat", "xox")),
)
#: Runs shorter than the rule's length can be passed over where a match cannot begin inside a longer one.
_RUNS = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
_SALTS = 16
LEDGER = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, version int, start int, end int"


def rule_table(spark, rules) -> DataFrame:
    return spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")


def _pieces(text, rule: Rule):
    """array<struct<kind, version, gap, size, least>> of a rule's matches in a text column, null where there is none: code points
    before the match, in it, and whether it is long enough."""
    pattern = F.lit(_RUNS.get(rule.kind, rule.pattern))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    each = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("m"), group.alias("g")),
        lambda x: F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.char_length(x["gap"]).alias("gap"),
            F.char_length(x["m"]).alias("size"), (F.char_length(x["g"]) >= rule.least).alias("long"),
        ),
    )
    tried = F.lit(True)
    if rule.needs:
        tried = F.contains(text, F.lit(rule.needs[0]))
        for n in rule.needs[1:]:
            tried = tried | F.contains(text, F.lit(n))
    # short circuit: `when` tries the pattern only where the fixed part is
    return F.when(F.when(tried, text.rlike(_RUNS.get(rule.kind, rule.pattern))).otherwise(False), each)


def scan(docs: DataFrame, rules=BASE_RULES + MORE_RULES, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text"):
    """(findings, scanned): findings (blob, kind, version, start, end) of the pairs that `ledger` does not have, and
    those pairs (blob, kind, version), which the caller appends to the ledger."""
    spark = docs.sparkSession
    paths = docs.select(F.col(key).alias("path"), F.sha2(text_of(text), 256).alias("blob"))
    holders = paths.groupBy("blob").agg(F.min("path").alias("path"))
    pairs = holders.crossJoin(F.broadcast(rule_table(spark, rules)))  # a row per rule
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
    pairs = stash(pairs, "ledger-pairs")
    todo = pairs.groupBy("blob", "path").agg(F.collect_set("kind").alias("todo"))  # one row per rule at most
    texts = docs.select(F.col(key).alias("path"), text_of(text).alias("text")).withColumn("blob", F.sha2("text", 256))
    # a holder's text; rows that repeat it give the same findings, made distinct below
    fresh = texts.join(todo, (texts.path.eqNullSafe(todo.path)) & (texts.blob == todo.blob)).select(todo.blob, "text", "todo")
    none = F.array().cast("array<struct<kind:string,version:int,gap:int,size:int,long:boolean>>")
    each = [F.coalesce(F.when(F.array_contains("todo", r.kind), _pieces(F.col("text"), r)), none) for r in rules]
    cut = fresh.select("blob", F.flatten(F.array(*each)).alias("cut")).filter(F.size("cut") > 0)
    rows = cut.select("blob", F.posexplode("cut").alias("at", "c")).select("blob", "at", "c.*").distinct()
    before = Window.partitionBy("blob", "kind", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(before).cast("int"))
    findings = rows.filter("long").select("blob", "kind", "version", (F.col("end") - F.col("size")).alias("start"), "end")
    return findings, pairs.select("blob", "kind", "version")


def _salt(key: str):
    """Deals the rows of a hot blob to several tasks."""
    return F.pmod(F.xxhash64(key), F.lit(_SALTS)).alias("salt")


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))


def by_path(docs: DataFrame, findings: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<start, rank, kind, end>>) for every row: findings of its blob, all rules and versions given."""
    paths = docs.select(F.col(key).alias("k"), F.sha2(text_of(text), 256).alias("blob"), _salt(key))
    order = [r.kind for r in BASE_RULES + MORE_RULES]
    rank = F.array_position(F.lit(order), F.col("kind"))
    per = findings.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,rank:bigint,kind:string,end:int>>")
    return paths.join(_salted(per), ["blob", "salt"], "left").select(F.col("k").alias(key), F.coalesce("spans", none).alias("spans"))


def new_ledger(spark) -> str:
    """An empty ledger's folder in the shared folder."""
    return f"{shared_dir(spark)}/tidegrid/secret-ledger-{uuid.uuid4().hex}"


def scan_into(docs: DataFrame, folder: str, rules=BASE_RULES + MORE_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan against the ledger under `folder` and append to it; the findings that the folder then holds under these rules.

    Findings are written before their ledger pairs: a run that ends between them is scanned again, and its findings are
    made distinct on reading.
    """
    spark = docs.sparkSession
    for name, schema in (("ledger", LEDGER), ("findings", FINDINGS)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/{name}")
    fresh, pairs = scan(docs, rules, spark.read.schema(LEDGER).parquet(f"{folder}/ledger"), key, text)
    fresh.write.mode("append").parquet(f"{folder}/findings")
    pairs.write.mode("append").parquet(f"{folder}/ledger")
    return known(spark, folder, rules)


def known(spark, folder: str, rules=BASE_RULES + MORE_RULES) -> DataFrame:
    """All findings of the ledger under `folder` under these rules and versions."""
    rows = spark.read.schema(FINDINGS).parquet(f"{folder}/findings").distinct()
    return rows.join(F.broadcast(rule_table(spark, rules)), ["kind", "version"]).select("blob", "kind", "version", "start", "end")


def redact(
    docs: DataFrame, mark: str = "[secret]", rules=BASE_RULES + MORE_RULES, key: str = "doc_id", text: str = "text", folder: str | None = None
) -> DataFrame:
    """`docs` with every finding replaced by `mark`, overlapping ones by one mark. Findings come from the ledger under `folder` (a new
    one if None), to which texts that it has not seen are added."""
    folder = folder or new_ledger(docs.sparkSession)
    found = scan_into(docs, folder, rules, key, text)
    # where findings overlap, the earliest start and the last end so far tell where a marked stretch begins
    order = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = found.select("blob", "start", "end").distinct().withColumn("opens", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int"))
    runs = opens.withColumn("run", F.sum("opens").over(order)).groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # the kept stretch before each marked one, and the rest
    last = F.lag("end", 1, 0).over(Window.partitionBy("blob").orderBy("start"))
    kept = runs.select("blob", F.struct(last.alias("from"), "start", "end").alias("s"))
    per = kept.groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("stretches"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(text_of(text), 256).alias("blob"), _salt(key))
    rows = rows.join(_salted(per), ["blob", "salt"], "left")
    body = F.col("row")[text]
    # four bytes a code point, so that a stretch is cut by its position and long texts of many findings take linear time; as a variable of a function the
    # encoded text is made once a row
    piece = lambda e, at, size: F.decode(F.substring(e, at * 4 + 1, size * 4), "UTF-32")
    end = F.element_at("stretches", -1)["end"]
    joined = lambda e: F.array_join(
        F.concat(F.transform("stretches", lambda s: piece(e, s["from"], s["start"] - s["from"])), F.array(piece(e, end, F.char_length(body) - end))), mark
    )
    clean = F.element_at(F.transform(F.array(F.encode(body, "UTF-32")), joined), 1)
    out = F.when(F.col("stretches").isNull() | body.isNull(), body).otherwise(clean)
    return rows.select(*[out.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
