"""Generated, minified, vendored and data files among source code (problem 4).

Thresholds on layout statistics, tuned per language: longest and mean line, shares
of white space, alphanumerics and numeric literals, long encoded runs, and how much
the shapes of lines repeat. What layout can't show is added as statistics of their own:
a tool's mark in the comments at either end of a file, a third party's header, and
the share of text that stands in known third-party files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspan.runtime import Scratch, spread

#: Per language: mean line and share of white space of minified code, share of numeric literals of data,
#: share of encoded runs of data, most distinct runs of three line shapes of generated code, and share of
#: lines of the shape of the line before from which code is generated.
LIMITS: dict[str, dict[str, float]] = {
    "py": {"mean": 150, "space": 0.12, "numbers": 0.25, "runs": 0.5, "repeat": 0.60, "adjacent": 0.5},
    "js": {"mean": 150, "space": 0.09, "numbers": 0.30, "runs": 0.5, "repeat": 0.25, "adjacent": 0.4},
    "ts": {"mean": 200, "space": 0.09, "numbers": 0.30, "runs": 0.5, "repeat": 0.40, "adjacent": 0.35},
    "css": {"mean": 200, "space": 0.05, "numbers": 0.40, "runs": 0.5, "repeat": 0.10, "adjacent": 0.6},
}
OTHER = {"mean": 200, "space": 0.08, "numbers": 0.30, "runs": 0.5, "repeat": 0.20, "adjacent": 0.5}
#: A longer mean line than this is no hand-written code in any language.
LONG_MEAN = 400
#: Line shapes are judged from this many lines on, neighbours alone from the lesser number.
REPEAT_LINES = 16
ADJACENT_LINES = 8
#: Share of comment lines, those at either end left out, from which repeated lines are hand-written all the same.
COMMENTED = 0.05
#: Share of letters and digits below which long lines are symbols rather than prose.
WORDY = 0.85
SHINGLE_LINES = 4
#: Share of a file's shingles found in third-party files from which it is a copy.
COPY_SHARE = 0.3

#: The characters of ``\s``; ``trim`` alone takes off only the space.
_BLANKS = " \t\n\x0b\f\r"
_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_NUMBER = r"(?<![A-Za-z_0-9])-?(?:0[xX][0-9a-fA-F]+|[0-9]+(?:\.[0-9]+)?)(?![A-Za-z_0-9])"
_RUN = r"[A-Za-z0-9+/=]{40,}|(?:\\x[0-9a-fA-F]{2}){16,}"
#: Beginnings of comment lines and of docstrings.
_COMMENT = ("#", "//", "/*", "*", '"""', "'''", "<!--", ";")
#: Ways in which tools mark their output, in the comments at the start or end of a file.
_MADE = "|".join(
    (
        r"@generated\b",
        r"\bcode generated (?:by|from|with)\b",
        r"^\W*(?:this (?:file|code|module) (?:is|was|has been) )?(?:auto(?:matically)?[- ]?generated|generated) (?:by|from|with|using|on)\b",
        r"\bauto-?generated\b.*\b(?:by|from|with|using|edit|manual|change)",
        r"^\W*(?:produced|created|written|built|emitted|rendered|exported|compiled) (?:automatically )?(?:by|with|from|using) \S+ v?[0-9]+(?:\.[0-9]+)+",
        r"\bemitted from\b",
        r"\b(?:edits?|changes?|modifications?)\b.*\b(?:overwritten|will be lost|are lost|lost on)\b",
        r"\bbelow come from\b.*\brebuild with\b",
        r"\bautomatisch\b.*\b(?:erzeugt|generiert|erstellt)\b",
        r"\b(?:g[eé]n[eé]r[eé]\w*|cr[eé][eé]) automatiquement\b",
        r"\b(?:generado|creado) autom[aá]ticamente\b",
    )
)
_HAND = r"written by hand|hand-?written|maintained by hand"
_UPSTREAM = r"upstream copy|vendored (?:copy|from)|copied (?:verbatim )?from (?:upstream|http)|copyright .*\b(?:contributors|authors|developers)\b"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _share(text: Column, kept: Column) -> Column:
    return F.try_divide(F.length(text) - F.length(kept), F.length(text))


def _block(lines: Column, remarks: Column) -> Column:
    """The leading lines that are comments; ``remarks`` flags the comment lines."""
    first_code = F.array_position(remarks, False).cast("int")
    return F.when(first_code == 0, lines).otherwise(F.slice(lines, F.lit(1), first_code - 1))


def _found(lines: Column, pattern: str) -> Column:
    return F.exists(lines, lambda x: F.lower(x).rlike(pattern))


def layout(files: DataFrame) -> DataFrame:
    """(file_id, lang, n_lines, max_line, mean_line, space, alnum, numbers, runs, repeat, adjacent, comments, made, upstream, shingles) per file.

    A line's shape has every run of letters and digits as one. ``repeat`` is the share of
    distinct ones among the runs of three shapes, ``adjacent`` the share of lines of the shape before
    them, ``comments`` the share of comment lines but for those at either end. ``shingles`` hashes runs of lines, without comments and blanks. Line ends
    of any kind count as one. A null or empty content has no lines and shares of null.
    """
    text = F.replace(F.replace(F.regexp_replace("content", "^\ufeff", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    base = spread(files.select("file_id", "file_path", "content"), files).select("file_id", F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)\s*$", 1)).alias("lang"), text.alias("text"))

    def shown(whole: Column) -> Column:
        return F.filter(F.transform(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")

    shape = F.regexp_replace(F.translate("text", _ALNUM + "_", "a" * 63), "a+", "a")
    folded = F.regexp_replace("text", r"[ \t\x0b\f]+", " ")
    base = base.select("*", F.transform(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != ""), lambda x: F.length(x)).alias("lengths"), shown(shape).alias("shapes"), shown(folded).alias("lines"))
    base = base.withColumn("remarks", F.transform("lines", lambda x: reduce(lambda a, b: a | b, [x.startswith(c) for c in _COMMENT])))
    base = base.withColumn("head", _block(F.col("lines"), F.col("remarks"))).withColumn("tail", _block(F.reverse("lines"), F.reverse("remarks")))
    total = F.aggregate("lengths", F.lit(0), lambda a, x: a + x)
    head, tail = F.col("head"), F.col("tail")
    base = base.withColumn("threes", _runs(F.col("shapes"), 3)).withColumn("norm", F.filter("lines", lambda x: ~x.startswith("#")))
    same = F.size(F.filter("shapes", lambda x, i: (i > 0) & (F.get("shapes", i - 1) == x)))
    inside = F.size(F.filter("remarks", lambda x: x)) - F.size(head) - F.size(tail)
    norm, threes = F.col("norm"), F.col("threes")
    return base.select(
        "file_id",
        "lang",
        F.size("lines").alias("n_lines"),
        F.array_max("lengths").alias("max_line"),
        F.try_divide(total, F.size("lines")).alias("mean_line"),
        _share(F.col("text"), _without(F.col("text"), _BLANKS)).alias("space"),
        _share(F.col("text"), _without(F.col("text"), _ALNUM)).alias("alnum"),
        _share(F.col("text"), F.regexp_replace("text", _NUMBER, "")).alias("numbers"),
        _share(F.col("text"), F.regexp_replace("text", _RUN, "")).alias("runs"),
        F.try_divide(F.size(F.array_distinct(threes)), F.size(threes)).alias("repeat"),
        F.try_divide(same, F.size("shapes")).alias("adjacent"),
        F.try_divide(F.greatest(inside, F.lit(0)), F.size("lines")).alias("comments"),
        ((_found(head, _MADE) & ~_found(head, _HAND)) | (_found(tail, _MADE) & ~_found(tail, _HAND))).alias("made"),
        (_found(head, _UPSTREAM) & ~_found(head, _HAND)).alias("upstream"),
        F.when(F.size(norm) > 0, F.array_distinct(_runs(norm, SHINGLE_LINES))).alias("shingles"),
    )


def _runs(lines: Column, n: int) -> Column:
    """Hashes of every run of n lines; fewer lines are one run.

    The array is zipped with itself shifted, so the work is linear in the lines.
    """
    last = F.greatest(F.size(lines) - n + 1, F.lit(1))
    runs = F.arrays_zip(*[F.slice(lines, F.lit(i + 1), last).alias(f"l{i}") for i in range(n)])
    return F.transform(runs, lambda r: F.xxhash64(F.concat_ws("\n", *[r[f"l{i}"] for i in range(n)])))


def _limit(name: str) -> Column:
    picked = F.lit(float(OTHER[name]))
    for lang, limits in LIMITS.items():
        picked = F.when(F.col("lang") == lang, F.lit(float(limits[name]))).otherwise(picked)
    return picked


def copied(stats: DataFrame, known: DataFrame) -> DataFrame:
    """(file_id, share): share of a file's line shingles that stand in known third-party files; files without a hit are left out."""
    catalog = layout(known.select(F.lit(0).alias("file_id"), F.col("file_name").alias("file_path"), "content"))
    hashes = catalog.select(F.explode("shingles").alias("h")).distinct()
    hits = stats.select("file_id", F.size("shingles").alias("n"), F.explode("shingles").alias("h")).join(hashes, "h", "left_semi")
    return hits.groupBy("file_id", "n").agg(F.count(F.lit(1)).alias("hit")).select("file_id", (F.col("hit") / F.col("n")).alias("share"))


def judged(files: DataFrame, known: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(file_id, reason, layout_reason and the statistics) of every file; both reasons are null for hand-written source.

    ``minified``: long mean line and hardly any blanks, or no hand-written line
    length at all. ``data``: numeric literals or encoded runs make up the file.
    ``generated``: ever the same shapes of lines and hardly a comment, or marked by a tool at either end.
    ``vendored``: third-party by its own header or by shared text. ``layout_reason`` is
    the reason by layout thresholds alone. An empty or null content is hand-written
    (there is nothing to tell).
    """
    scratch = scratch or Scratch(files.sparkSession, "layout")
    stats = scratch.cut(layout(files))
    s = stats.drop("shingles").join(copied(stats, known), "file_id", "left")
    minified = ((F.col("mean_line") >= _limit("mean")) & (F.col("space") <= _limit("space")) & (F.col("alnum") <= WORDY)) | (F.col("mean_line") >= LONG_MEAN)
    data = (F.col("numbers") >= _limit("numbers")) | (F.col("runs") >= _limit("runs"))
    repeated = ((F.col("n_lines") >= REPEAT_LINES) & (F.col("repeat") <= _limit("repeat"))) | ((F.col("n_lines") >= ADJACENT_LINES) & (F.col("adjacent") >= _limit("adjacent")))
    by_layout = F.when(data, "data").when(minified, "minified").when(repeated & (F.col("comments") < COMMENTED), "generated")
    marked = F.when(F.col("made"), "generated").when(F.col("upstream") | (F.col("share") >= COPY_SHARE), "vendored")
    # A mark names the reason better than repeated lines do: a copied table of names is vendored.
    reason = F.when(by_layout.isin("data", "minified"), by_layout).otherwise(F.coalesce(marked, by_layout))
    return s.withColumn("layout_reason", by_layout).withColumn("reason", reason)


def found(files: DataFrame, known: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(file_id) of the files that nobody wrote by hand."""
    return judged(files, known, scratch).where(F.col("reason").isNotNull()).select("file_id").distinct()


def hand_written(files: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``files`` that are hand-written source."""
    return files.join(found(files, known), "file_id", "left_anti")
