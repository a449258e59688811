"""Line deduplication by distinct-site spread. Main path: DataFrame functions only.

A line is boilerplate when it is on at least `sites` distinct sites and in at least `sites` distinct surroundings. Lines on `sites` sites or more are
widespread; what a text has besides them, as a set, is its residue. Exact copies and texts that differ in widespread lines only have one residue and count
once; a header counts with whatever content stands below it, be that a line among ten. Texts nearly all of whose lines are
widespread (a residue of `near` or less of their lines) are no evidence: they are copies and near copies of one text, or have too little of their own to
tell. So the lines of a text that is copied to many sites stay, with an edited line or not.

Sites and residues are counted alike: HyperLogLog sketches per line hash merge by aggregation, and lines whose estimate lies
near the threshold get exact distinct counts. Boilerplate goes from every document, whatever its residue.

A hot line's rows are salted by text before they meet its sketch, and the copies of a hot text by a hash of their other columns
before they meet its lines. A line: text between \\n; compared by a 64-bit hash without white space at its ends; blank lines are
never counted or removed. Sites: the source column; null is a site of its own. Null text stays null. A document all of whose
lines are boilerplate keeps an empty text. Flags go by content, so repeated rows give repeated results and keys may be null.
Texts of any length are one row with an array of line hashes. Extra columns stay as they are, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegrid.llm.common import stash, text_of

_SALTS = 16


def line_key(line):
    """Hash of a line as it is compared; null for a blank one."""
    plain = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(F.length(plain) > 0, F.xxhash64(plain))


def line_rows(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(t, site, line, salt) of every line that is not blank; t: hash of the text."""
    keys = docs.select(
        F.xxhash64(text_of(text)).alias("t"),
        F.coalesce(F.col(source).cast("string"), F.lit("\0null")).alias("site"),
        F.explode(F.filter(F.transform(F.split(text_of(text), "\n", -1), line_key), F.isnotnull)).alias("line"),
    )
    return keys.withColumn("salt", F.pmod("t", F.lit(_SALTS)).cast("int"))


def _salted(rows: DataFrame, name: str = "salt") -> DataFrame:
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))


def spread(rows: DataFrame, sites: int, margin: float = 0.3, lg_k: int = 12) -> DataFrame:
    """(line, n_sites, exact) of the lines on `sites` distinct sites or more; n_sites is an estimate where exact is false. `rows`:
    (line, site, salt)."""
    part = rows.groupBy("line", "salt").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    whole = part.groupBy("line").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_sites"))
    whole = stash(whole.filter(F.col("n_sites") >= (1 - margin) * sites), "lines-estimates")
    near = whole.filter(F.col("n_sites") <= (1 + margin) * sites).select("line")
    pairs = rows.join(_salted(near), ["line", "salt"]).select("line", "site").distinct()
    exact = pairs.groupBy("line").agg(F.count("*").alias("n_sites")).filter(F.col("n_sites") >= sites)
    far = whole.filter(F.col("n_sites") > (1 + margin) * sites)
    return far.withColumn("exact", F.lit(False)).unionByName(exact.withColumn("exact", F.lit(True)))


def boilerplate(rows: DataFrame, sites: int, margin: float = 0.3, near: float = 0.125) -> tuple[DataFrame, DataFrame]:
    """(lines, widespread): (line, n_sites, exact) of boilerplate, counted over texts with more than `near` of their own, and (t, line) of all lines on
    `sites` sites or more in any texts; written tables."""
    frequent = rows.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= sites).select("line")
    wide = spread(rows.join(_salted(stash(frequent, "lines-frequent")), ["line", "salt"]), sites, margin).select("line")
    wide = _salted(stash(wide, "lines-widespread")).withColumn("hit", F.lit(1))
    marked = rows.join(wide, ["line", "salt"], "left")
    hit = F.coalesce("hit", F.lit(0))
    # copies of a text count alike above and below, so shares are those of one copy
    texts = marked.groupBy("t").agg(
        F.sum(hit).alias("hits"), F.count("*").alias("lines"), F.collect_set(F.when(hit == 1, F.col("line"))).alias("found"), F.collect_set(F.when(hit == 0, F.col("line"))).alias("rest")
    ).filter("hits > 0")
    own = F.col("lines") - F.col("hits") > F.col("lines") * near
    texts = stash(texts.select("t", own.alias("own"), F.xxhash64(F.sort_array("rest")).alias("residue"), "found"), "lines-texts")
    at = rows.select("t", "site").distinct()
    evidence = texts.filter("own").select("t", "residue", F.explode("found").alias("line")).join(at, "t")
    evidence = stash(evidence.withColumn("salt", F.pmod("t", F.lit(_SALTS)).cast("int")), "lines-evidence")
    varied = spread(evidence.select("line", F.col("residue").cast("string").alias("site"), "salt"), sites, margin).select("line")
    lines = spread(evidence.select("line", "site", "salt"), sites, margin).join(varied, "line", "left_semi")
    return stash(lines, "lines-boilerplate"), texts.select("t", F.explode("found").alias("line"))


def dedup_lines(
    docs: DataFrame, sites: int = 10, margin: float = 0.3, text: str = "text", source: str = "source", report: bool = False, near: float = 0.125,
) -> DataFrame:
    """`docs` with boilerplate lines gone from the text; with `report`, instead (row struct of the columns so cleaned, lines_before,
    lines_removed long)."""
    rows = stash(line_rows(docs, text, source), "lines")
    lines, widespread = boilerplate(rows, sites, margin, near)
    salted = widespread.withColumn("salt", F.pmod("t", F.lit(_SALTS)).cast("int")).join(_salted(lines.select("line")), ["line", "salt"])
    gone = _salted(salted.groupBy("t").agg(F.collect_set("line").alias("gone")), "deal")
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c != text and "map<" not in kind and "variant" not in kind]
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64(text_of(text)).alias("t"),
        F.pmod(F.xxhash64(*others) if others else F.lit(0), F.lit(_SALTS)).cast("int").alias("deal"),
    ).join(gone, ["t", "deal"], "left")
    body = F.col("row")[text].cast("string")
    split = F.split(F.coalesce(body, F.lit("")), "\n", -1)
    kept = F.filter(split, lambda x: F.coalesce(~F.array_contains("gone", line_key(x)), F.lit(True)))
    out = out.select("row", "gone", F.size(split).cast("long").alias("lines_before"), F.when(F.col("gone").isNotNull(), kept).alias("kept"))
    body = F.col("row")[text]
    clean = F.when(body.isNull() | F.col("gone").isNull(), body).otherwise(F.array_join("kept", "\n"))
    columns = [clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    if not report:
        return out.select(*columns)
    removed = F.coalesce(F.col("lines_before") - F.size("kept"), F.lit(0).cast("long"))
    return out.select(F.struct(*columns).alias("row"), "lines_before", removed.alias("lines_removed"))
