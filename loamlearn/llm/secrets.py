"""Secret scan with corpus-wide ownership frequency (DataFrame operations only).

Candidates come from fixed patterns. Each candidate's value is hashed and the hashes are counted by
distinct repositories and owners over the whole corpus: a value that ``copied`` owners or more hold is
a widely copied ``example``, one of several owners is ``shared``, and one that a single owner holds is
``live`` if it looks like a credential: it has enough different characters for its length and none of
the words and runs that placeholders are made of; otherwise it is an ``example`` too. Counting needs only
the candidates; texts are read once, and only texts with secrets are shuffled, to be masked.

Defined cases: null text is empty; a null repository or owner counts as one of its own; repeated rows
are scanned each; an empty table gives an empty result; other columns are ignored. Offsets are code
points, end exclusive. Work on a text grows with its length and its number of candidates, not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, free_name

#: Kind, pattern, group that holds the value, fewest characters of it.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Spans that the method adds to the base ones.
MORE = (
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 60),
)
KINDS = BASE + MORE


#: What placeholders are made of.
PLACEHOLDER = r"(?i)example|sample|placeholder|change_?me|dummy|your|xxxx|0000|1111|12345|abcde|qwerty"
#: One value's rows are dealt over as many tasks when they meet its counts.
SALTS = 8
#: Code points of the pieces that a text is cut into before parts of it are taken.
PIECE = 1 << 16


def looks_live(value: Column) -> Column:
    """Six different characters, one more for each 16 of its length up to twelve, and nothing of a placeholder."""
    least = F.least(F.lit(12), F.lit(6) + F.floor(F.length(value) / 16))
    return (F.size(F.array_distinct(F.split(value, ""))) >= least) & ~value.rlike(PLACEHOLDER)


_FOUND = "array<struct<order:int,i:int,gap:int,n:int,hash:string,good:boolean,live:boolean>>"


def _found(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one pattern in their order, each with the length of the piece before it, its own and its value."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    pieces = F.split(text, pattern, -1)
    met = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(hits)), lambda p: F.length(p)).alias("gap"), F.transform(hits, lambda h: F.length(h)).alias("n"), values.alias("v"))
    one = lambda x, i: F.struct(F.lit(order).alias("order"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), F.sha2(x["v"], 256).alias("hash"), (F.length(x["v"]) >= least).alias("good"), looks_live(x["v"]).alias("live"))
    return F.when(text.rlike(pattern), F.transform(met, one)).otherwise(F.array().cast(_FOUND))


def _scanned(docs: DataFrame, ws: Workspace, names: dict[str, str], text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """``docs`` with a row number, repository, owner and matches under ``names``, saved: texts are searched once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    found = F.flatten(F.array(*[_found(text, i, *k) for i, k in enumerate(KINDS)]))
    return ws.save(docs.withColumns({names["repo"]: of(repo_col), names["owner"]: of(owner_col), names["found"]: found, names["row"]: F.monotonically_increasing_id()}), "rows")


def _judged(rows: DataFrame, names: dict[str, str], copied: int) -> DataFrame:
    """row, start, order, end, kind, base, verdict, repos, owners: one row a candidate."""
    every = rows.filter(F.size(names["found"]) > 0).select(F.col(names["row"]).alias("row"), F.col(names["repo"]).alias("repo"), F.col(names["owner"]).alias("owner"), F.explode(names["found"]).alias("x")).select("row", "repo", "owner", "x.*")
    upto = Window.partitionBy("row", "order").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("n")).filter("good")
    # distinct pairs first: one value in a third of all rows is one row a repository and owner
    held = every.select("hash", "repo", "owner").distinct()
    held = held.groupBy("hash").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    every = every.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int")).join(held, ["hash", "salt"])
    kinds = F.array(*[F.lit(k[0]) for k in KINDS])
    verdict = F.when((F.col("owners") >= copied) | ~F.col("live"), "example").when(F.col("owners") > 1, "shared").otherwise("live")
    return every.select("row", "start", "order", "end", F.get(kinds, F.col("order")).alias("kind"), (F.col("order") < len(BASE)).alias("base"), verdict.alias("verdict"), "repos", "owners")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied: int = 3) -> DataFrame:
    """doc_id, spans: array<(start, order, end, kind, base, verdict, repos, owners)> sorted by start, then kind as listed;
    one row for each row of ``docs``. By default a document is a repository, of the owner that its source names."""
    ws = Workspace(docs.sparkSession, "secrets")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(repo_col).alias("in_repo"), F.col(owner_col).alias("of_owner"))
    names = {k: k for k in ("row", "repo", "owner", "found")}
    # the text is not saved: it is read in this pass alone
    rows = _scanned(narrow, _Without(ws, ("text", "in_repo", "of_owner")), names, "text", "in_repo", "of_owner")
    per = _judged(rows, names, copied).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "order", "end", "kind", "base", "verdict", "repos", "owners"))).alias("spans"))
    none = F.array().cast(per.schema["spans"].dataType)
    return rows.select("doc_id", "row").join(per, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


class _Without:
    """A workspace that leaves some columns out of what it saves."""

    def __init__(self, ws: Workspace, columns: tuple):
        self.ws, self.columns = ws, columns

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self.ws.save(df.drop(*self.columns), name)


def redact_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied: int = 3) -> DataFrame:
    """``docs`` with [SECRET] in place of every live or shared span, overlapping ones as one.

    Only texts with a candidate are shuffled, to meet their spans.
    """
    ws = Workspace(docs.sparkSession, "redacted")
    names = {k: free_name(docs, k) for k in ("row", "repo", "owner", "found")}
    rows = _scanned(docs, ws, names, text_col, repo_col, owner_col)
    bad = _judged(rows, names, copied).filter("verdict <> 'example'")
    before = Window.partitionBy("row").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    bad = bad.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    # a span that starts where or behind all earlier ones end has a kept piece before it
    cut, cuts, tail = free_name(docs, "cut"), free_name(docs, "cuts"), free_name(docs, "tail")
    per = bad.groupBy(F.col("row").alias(cut)).agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct("start", "from")))).alias(cuts), F.max("end").alias(tail))
    some = rows.filter(F.size(names["found"]) > 0).join(per, F.col(names["row"]) == F.col(cut), "left")
    some = some.withColumn(text_col, F.when(F.col(tail).isNull(), F.col(text_col)).otherwise(masked(F.col(text_col), F.col(cuts), F.col(tail))))
    return some.select(*docs.columns).unionByName(rows.filter(F.size(names["found"]) == 0).select(*docs.columns))


def masked(text: Column, cuts: Column, tail: Column) -> Column:
    """The text's pieces [from, start) of ``cuts``, each with [SECRET] behind it, and what follows ``tail``.

    Pieces are taken from parts of PIECE code points, so that none is sought from the text's beginning.
    """
    n = F.length(text)
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / PIECE).cast("int")), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))

    def piece(p: Column, a: Column, z: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor((z - 1) / PIECE).cast("int")
        inner = F.concat_ws("", F.slice(p, first + 2, F.greatest(last - first - 1, F.lit(0))))
        one = F.substring(F.get(p, first), a - first * PIECE + 1, z - a)
        many = F.concat(F.substring(F.get(p, first), a - first * PIECE + 1, F.lit(PIECE)), inner, F.substring(F.get(p, last), F.lit(1), z - last * PIECE))
        return F.when(z <= a, F.lit("")).when(first == last, one).otherwise(many)

    # a one-element transform computes the parts once for all pieces
    done = F.transform(F.array(F.struct(parts.alias("p"))), lambda x: F.concat(F.concat_ws("", F.transform(cuts, lambda c: F.concat(piece(x["p"], c["from"], c["start"]), F.lit("[SECRET]")))), piece(x["p"], tail, n)))
    return F.get(done, F.lit(0))
