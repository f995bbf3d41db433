"""URL filters against dated lists: an as-of join of captures with the entries active when they were fetched.

A list is a log of dated entries (pattern, list name, action).  For one
pattern on one list an entry holds until the next one, so the log becomes
half-open validity intervals; "remove" ends what held before.  A pattern is a
host, which covers its subdomains, or a host with leading path segments.  Every
capture asks for all patterns that could cover it by equality, and of the
intervals that hold on its day the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, join_hot

ACTIONS = ("block", "allow", "remove")
#: Up to so many intervals are sent to every executor; more are joined by shuffle.
BROADCAST_ROWS = 200_000

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url):
    """Lower-case host without user, port or a dot at its end; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")


def patterns_of(url):
    """All patterns that cover a URL, the most specific last: each suffix of the host, then the host with 1, 2, ... path segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda x: x != "")
    n, m = F.size(labels), F.size(segments)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, n - i + 1, i), "."))
    paths = F.when(m > 0, F.transform(F.sequence(F.lit(1), m), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/"))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(domains, F.coalesce(paths, F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (pattern, list_name, action, since) to (pattern, list_name, action, valid_from, valid_to).

    Of several entries for one pattern, list and day the strongest holds:
    block over allow over remove.  valid_to is null while an entry still holds.
    """
    strength = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    known = entries.where(F.col("pattern").isNotNull() & F.col("since").isNotNull() & strength.isNotNull())
    day = known.groupBy(F.regexp_replace(F.lower("pattern"), r"[./]+$", "").alias("pattern"), F.coalesce("list_name", F.lit("")).alias("list_name"), F.col("since").cast("date").alias("valid_from")).agg(F.max(strength).alias("strength"))
    run = Window.partitionBy("pattern", "list_name").orderBy("valid_from")
    closed = day.withColumn("valid_to", F.lead("valid_from").over(run)).where("strength > 0")
    return closed.select("pattern", "list_name", F.when(F.col("strength") == 2, "block").otherwise("allow").alias("action"), "valid_from", "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """captures (url, fetched_on, and any others) with verdict, pattern, list_name and valid_from of the entry that decides.

    verdict is "block", "allow" or "none".  The longest pattern wins, then the
    interval that began last, block before allow, and the smaller list name.
    A null URL or day, or a URL without a host, gets "none"; every row of
    captures comes back once, repeated rows too; the other columns, whatever their names, are left alone
    (one named like a result is replaced by it).  Empty captures give an empty result, empty
    entries "none" throughout.
    """
    made = ["verdict", "pattern", "list_name", "valid_from"]
    kept = [c for c in captures.columns if c not in made]
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    rows = rows.select("row", F.monotonically_increasing_id().alias("id"), F.col("row.fetched_on").cast("date").alias("day"), patterns_of(F.col("row.url").cast("string")).alias("patterns"))
    asked = rows.select("row", "id", "day", F.explode_outer("patterns").alias("pattern"))
    valid = intervals(entries)
    if valid.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = asked.join(F.broadcast(valid.withColumnRenamed("pattern", "p")), (F.col("pattern") == F.col("p")) & (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))), "left")
    else:
        # each pattern's intervals as one row, so that the join has one match per key and hot patterns can go by broadcast
        held = valid.groupBy("pattern").agg(F.collect_list(F.struct("list_name", "action", "valid_from", "valid_to")).alias("held"))
        hot, _ = hot_keys(asked.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "pattern")
        joined = join_hot(asked, held, "pattern", hot)
        active = F.filter("held", lambda x: (F.col("day") >= x["valid_from"]) & (x["valid_to"].isNull() | (F.col("day") < x["valid_to"])))
        met = joined.select("row", "id", "day", "pattern", F.explode_outer(active).alias("e")).select("row", "id", "pattern", "e.list_name", "e.action", "e.valid_from").withColumn("p", F.when(F.col("action").isNotNull(), F.col("pattern")))
    # the least of: fewer path segments last, then fewer host labels, an earlier start, allow after block, list names in order
    depth = F.size(F.split("p", "/")) * 1000 + F.size(F.split(F.element_at(F.split("p", "/"), 1), r"\."))
    rank = F.struct((-depth).alias("depth"), (-F.unix_date("valid_from")).alias("since"), (F.col("action") != "block").alias("weaker"), "list_name", "p", "action", "valid_from")
    one = met.groupBy("id").agg(F.first("row").alias("row"), F.min(F.when(F.col("p").isNotNull(), rank)).alias("top"))
    out = one.select("row.*", F.coalesce("top.action", F.lit("none")).alias("verdict"), F.col("top.p").alias("pattern"), F.col("top.list_name").alias("list_name"), F.col("top.valid_from").alias("valid_from"))
    return out.select(*[F.col(f"`{c}`") for c in kept], *made)


#: The list of the query: dated entries for the hosts of an invented web.  Fixed values.
ENTRIES = """
free-bets.example.com      gambling block  2024-01-01
free-bets.example.com      gambling remove 2024-05-01
free-bets.example.com      gambling block  2024-08-15
free-bets.example.net      gambling block  2024-02-01
free-bets.example.org      gambling block  2024-02-01
free-bets.example.com/en   review   allow  2024-09-01
free-bets.example.net/en   review   allow  2024-09-01
casino-win.example.com     gambling block  2024-01-15
casino-win.example.net     gambling block  2024-01-15
casino-win.example.org     gambling block  2024-03-15
www.casino-win.example.org review   allow  2024-06-01
www.casino-win.example.org review   remove 2024-10-01
blog.casino-win.example.net review  allow  2024-06-01
cheap-pills.example.com    pharmacy block  2024-01-01
cheap-pills.example.net    pharmacy block  2024-04-01
cheap-pills.example.org    pharmacy block  2024-04-01
cheap-pills.example.net    fraud    block  2024-06-01
cheap-pills.example.com    pharmacy remove 2024-11-01
adult-x.example.com        adult    block  2024-01-01
adult-x.example.net        adult    block  2024-01-01
adult-x.example.org        adult    block  2024-01-01
adult-x.example.com/de     adult    allow  2024-07-01
spam-farm.example.com      spam     block  2024-01-10
spam-farm.example.net      spam     block  2024-01-10
spam-farm.example.org      spam     block  2024-01-10
spam-farm.example.org      spam     remove 2024-12-01
ads-track.example.com      adverts  block  2024-03-01
ads-track.example.net      adverts  block  2024-03-01
ads-track.example.org      adverts  block  2024-03-01
ads-track.example.com/en   adverts  remove 2024-03-01
tionsh.example.net         mirrors  block  2024-01-01
blog.tionsh.example.net    review   allow  2024-04-01
blog.tionsh.example.net/de mirrors  block  2024-05-01
blog.tionsh.example.net/de review   allow  2024-09-01
blog.tionsh.example.net    review   remove 2024-11-01
thther.example.org         mirrors  block  2024-02-01
thther.example.org/en      review   allow  2024-03-01
thther.example.org         mirrors  remove 2024-10-01
"""


def entry_rows() -> list[tuple[str, str, str, str]]:
    return [tuple(line.split()) for line in ENTRIES.strip().splitlines()]
