r"""Secret scan with corpus-wide ownership frequency.

Native: DataFrame functions only.

Three base kinds are matched leftmost and non-overlapping: ``assign`` (a
keyword, a sign and a value), ``access`` (an access key id) and ``hex`` (a long
hexadecimal run).  Matches whose value is too short are dropped after matching,
so a dropped match still consumes its characters.  Positions come from the
lengths of the pieces between the matches (``split`` and ``regexp_extract_all``
cut the text at the same places) by a running sum over the matches of a row.

Then every candidate value is hashed and counted over the corpus by distinct
repositories and distinct owners.  A value that ``MIN_OWNERS`` owners or more
hold is a widely copied example, and so is one that fewer owners hold, but two at
least, in ``MIN_REPOSITORIES`` repositories or more; a value that only one owner
holds is its own however many repositories have it.  What is no example and looks
live (enough different characters, letters and digits) is a credential of its
owner.  Each candidate adds a span over its value: ``example`` or ``live``; values
that are neither add none.  Base spans always stay.

Counts go through (hash, owner, repository) groups first, so a value that a
third of all rows hold is reduced map-side; the verdicts come back by a
sort-merge join that adaptive execution can split.

Defined cases: null and empty texts have no spans (digest of the empty string);
rows with equal ids are separate rows; null owners and repositories count as
one; an empty table gives no row; the operator reads its named columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import written

# The patterns of the base kinds, letters of the keywords in either case.
ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# whole runs either way, as a shorter run holds no longer one
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: kind, pattern, group of the value, least length of the value; listed order breaks ties of the start.
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: Cheap tests that hold for every text with a kept match of the kind.
MAY = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: What the method adds, ordered after the base kinds.
ADDED = ("live", "example")
MIN_OWNERS, MIN_REPOSITORIES = 3, 4
#: A live-looking value has so many different characters, and letters and digits.
MIN_DISTINCT = 8


def _pieces(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<gap int, found string>>, or null where nothing can match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(text.rlike(MAY[kind]), F.arrays_zip(gaps.alias("gap"), found.alias("found")))


def scanned(docs: DataFrame, text: str = "text", owner: str = "source", repository: Column | None = None, keep: tuple = ("doc_id",)) -> DataFrame:
    """A written table: __row, the kept columns, owner, repository, and the pieces of each kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    repo = F.concat_ws("/", F.col(owner), F.col("lang")) if repository is None else repository
    cols = [_pieces(whole, k, p).alias(f"__{k}") for k, p, _, _ in KINDS]
    rows = docs.select(*keep, F.col(owner).cast("string").alias("__owner"), repo.alias("__repo"), *cols)
    return written(rows.withColumn("__row", F.monotonically_increasing_id()), "secrets")


def base_spans(rows: DataFrame) -> DataFrame:
    """__row, owner, repository, order, kind, start, end (exclusive, code points), value."""
    out = None
    for n, (kind, pattern, group, least) in enumerate(KINDS):
        at = F.posexplode(f"__{kind}").alias("__at", "__piece")
        x = rows.filter(F.size(f"__{kind}") > 1).select("__row", "__owner", "__repo", at)
        x = x.select("__row", "__owner", "__repo", "__at", F.col("__piece.gap").alias("gap"), F.col("__piece.found").alias("found"))
        upto = Window.partitionBy("__row").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
        ends = F.sum(F.col("gap") + F.coalesce(F.length("found"), F.lit(0))).over(upto)
        x = x.withColumn("end", ends).filter("found is not null")
        value = F.regexp_extract("found", pattern, group) if group else F.col("found")
        x = x.select("__row", "__owner", "__repo", F.lit(n).alias("__n"), F.lit(kind).alias("kind"), (F.col("end") - F.length("found")).alias("start"), "end", value.alias("value"))
        x = x.filter(F.length("value") >= least)
        out = x if out is None else out.unionByName(x)
    return out


def ownership(spans: DataFrame) -> DataFrame:
    """Per value digest: how often, in how many repositories and by how many owners it is held."""
    held = spans.select(F.sha2("value", 256).alias("digest"), F.coalesce("__owner", F.lit("\x00")).alias("o"), F.coalesce("__repo", F.lit("\x00")).alias("r"))
    held = held.groupBy("digest", "o", "r").agg(F.count("*").alias("n"))
    return held.groupBy("digest").agg(F.sum("n").alias("occurrences"), F.count_distinct("r").alias("repositories"), F.count_distinct("o").alias("owners"))


def looks_live(value: Column) -> Column:
    """Letters and digits, enough different characters, and no word of a placeholder."""
    letters = F.array_distinct(F.split(value, ""))
    return (F.size(letters) >= MIN_DISTINCT) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~F.lower(value).rlike("example|placeholder|changeme|xxxx")


def copied(owners: Column, repositories: Column, min_owners: int = MIN_OWNERS, min_repositories: int = MIN_REPOSITORIES) -> Column:
    """Whether a value that so many owners and repositories hold is a widely copied example."""
    return (owners >= min_owners) | ((owners >= 2) & (repositories >= min_repositories))


def judged(spans: DataFrame, min_owners: int = MIN_OWNERS, min_repositories: int = MIN_REPOSITORIES) -> DataFrame:
    """The spans the method adds, one per candidate: kind live or example, over the value, with its owners and repositories."""
    counts = ownership(spans).filter("digest is not null")
    x = spans.withColumn("digest", F.sha2("value", 256)).join(counts, "digest")
    kind = F.when(copied(F.col("owners"), F.col("repositories"), min_owners, min_repositories), "example").when(looks_live(F.col("value")), "live")
    x = x.withColumns({"kind": kind, "start": F.col("end") - F.length("value")}).filter("kind is not null")
    order = F.when(F.col("kind") == "live", len(KINDS)).otherwise(len(KINDS) + 1)
    # a value that two base kinds found is one added span
    one = [F.first(c).alias(c) for c in ("__n", "value", "owners", "repositories")]
    return x.withColumn("__n", order).groupBy("__row", "kind", "start", "end").agg(*one)


def scan_secrets(docs: DataFrame, min_owners: int = MIN_OWNERS, min_repositories: int = MIN_REPOSITORIES, keep: tuple = ("doc_id",), **columns) -> DataFrame:
    """Per row of ``docs``: the kept columns and all spans, ordered.

    Returns ``keep``, ``found``: array<struct<start, __n, end, kind, value, owners,
    repositories>>; the last two are null in base spans.
    """
    rows = scanned(docs, keep=keep, **columns)
    spans = written(base_spans(rows), "secret-spans")
    cols = ("__row", F.struct("start", "__n", "end", "kind", "value", "owners", "repositories").alias("x"))
    nobody = {c: F.lit(None).cast("long") for c in ("owners", "repositories")}
    every = spans.withColumns(nobody).select(*cols).unionByName(judged(spans, min_owners, min_repositories).select(*cols))
    found = every.groupBy("__row").agg(F.sort_array(F.collect_list("x")).alias("found"))
    out = rows.select("__row", *keep).join(found, "__row", "left").drop("__row")
    nothing = F.from_json(F.lit("[]"), out.schema["found"].dataType.simpleString())
    return out.withColumn("found", F.coalesce("found", nothing))
