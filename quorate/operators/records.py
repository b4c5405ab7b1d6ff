"""Records from outside: cleaning, classifying and matching before they become votes, items and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import linkage

#: Kinds of motion by how the text begins, then by words that it holds, in order of test.
KINDS_BY_START = [("Emergency Final Action", "emergency final action"), ("Final Action", "final action"), ("Committee of the Whole", "committee of the whole"), ("Consent Calendar", "consent calendar")]
KINDS_BY_WORDS = [("Veto Override", ("override", "veto")), ("Conference Committee", ("conference committee",)), ("Concurrence", ("concur",))]
#: Order of bill prefixes.
BILL_ORDER = {"sb": 0, "sr": 1, "scr": 2, "hb": 3, "hr": 4, "hcr": 5}


def motion_kind(text: Column) -> Column:
    t, out = F.lower(F.trim(text)), None
    for kind, start in KINDS_BY_START:
        out = F.when(t.startswith(start), kind) if out is None else out.when(t.startswith(start), kind)
    for kind, words in KINDS_BY_WORDS:
        hit = t.contains(words[0])
        for w in words[1:]:
            hit = hit & t.contains(w)
        out = out.when(hit, kind)
    return out.otherwise("")


def bill_of_url(url: Column) -> Column:
    """"/measures/sb55/" to "SB 55"; null if there is none."""
    prefix, number = (F.regexp_extract(F.lower(url), r"/measures/([a-z]+)(\d+)", k) for k in (1, 2))
    return F.when(prefix != "", F.concat(F.upper(prefix), F.lit(" "), number))


def bill_key(bill: Column) -> tuple[Column, Column]:
    """What bills are sorted by: prefix, then number; unknown ones last."""
    prefix, number = F.lower(F.split(bill, " ")[0]), F.try_element_at(F.split(bill, " "), F.lit(2)).cast("int")
    order = F.lit(9)
    for p, k in BILL_ORDER.items():
        order = F.when(prefix == p, k).otherwise(order)
    return F.when(number.isNull(), 99).otherwise(order), F.coalesce(number, F.lit(0))


#: Ligatures that texts taken from PDF files hold, and their letters.
LIGATURES = {"\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}


def strip_line_numbers(text: Column) -> Column:
    """Numbers of one or two digits in the left margin taken out; longer ones are text."""
    return F.regexp_replace(text, r"(?md)^[ \t]{0,4}[0-9]{1,2}[ \t]{1,4}", "")


def clean_text(text: Column) -> Column:
    """Ligatures spelled out, lines that are a page number emptied, words that a line end broke joined, repeated white space taken out."""
    for one, letters in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(letters))
    paged = F.regexp_replace(text, r"(?md)^[ \t]*[0-9]{1,3}[ \t]*$", "")
    joined = F.regexp_replace(paged, r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"\n\n\n+", "\n\n"), F.lit(" \n\t\r"))


def sponsor(raw: Column) -> tuple[Column, Column]:
    """(name, chamber) of "Senator Tyson"; both null for committees and anything else."""
    title, name = (F.regexp_extract(F.trim(raw), r"^(?i)(senator|representative)\s+(.*)$", k) for k in (1, 2))
    ok = (title != "") & (F.trim(name) != "") & ~F.lower(raw).contains("committee")
    return F.when(ok, F.trim(name)), F.when(ok, F.when(F.lower(title) == "senator", "Senate").otherwise("House"))


def sponsor_party(sponsors: DataFrame, members: DataFrame) -> DataFrame:
    """Sponsors (raw) with the first member of that last name and chamber."""
    name, chamber = sponsor(F.col("raw"))
    keyed = members.select(linkage.last_name(F.col("full_name")).alias("last"), F.col("chamber").alias("in"), F.struct("voter", "party").alias("m"))
    first = keyed.groupBy("last", "in").agg(F.min("m").alias("m"))
    rows = sponsors.withColumns({"name": name, "chamber": chamber})
    return rows.join(first, (linkage.last_name(F.col("name")) == F.col("last")) & (F.col("chamber") == F.col("in")), "left").select(*sponsors.columns, "name", "chamber", F.col("m.voter").alias("voter"), F.col("m.party").alias("party"))


def sponsorship(items: DataFrame) -> DataFrame:
    """How many bills each sponsor of (bill, motion, sponsors) signs, and how many as the first name."""
    once = items.dropDuplicates(["bill", "motion", "sponsors"])
    each = once.select("bill", F.posexplode(F.split("sponsors", "; ")).alias("place", "name"))
    each = each.withColumn("name", F.trim("name")).where("name <> ''")
    return each.groupBy("name").agg(F.countDistinct("bill").alias("bills"), F.countDistinct(F.when(F.col("place") == 0, F.col("bill"))).alias("primary"))


def tidy_members(members: DataFrame) -> DataFrame:
    """Names without trailing roles, blank parties as Independent."""
    party = F.when(F.col("party").isNull() | (F.trim("party") == ""), "Independent").otherwise(F.col("party"))
    return members.withColumns({"full_name": F.trim(F.regexp_replace("full_name", r"\s+-\s+.*$", "")), "party": party})


def slug(name: Column, chamber: Column) -> Column:
    """Chamber prefix and last name in ASCII letters."""
    return F.concat(F.when(chamber == "Senate", "sen_").otherwise("rep_"), F.regexp_replace(linkage.last_name(name), "[^a-z]", ""))


def vote_time(vote_id: Column) -> Column:
    """Timestamp of an id that holds its time as digits, YYYYMMDDHHMMSS."""
    digits = F.regexp_extract(vote_id, r"(\d{14})", 1)
    return F.when(digits != "", F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))


def gap_fill(old: DataFrame, new: DataFrame, keys: list[str], label: str = "kf_") -> DataFrame:
    """``old`` without its earlier filled rows, and the rows of ``new`` whose keys it lacks, labelled."""
    kept = old.where(~F.col("id").startswith(label))
    added = new.join(kept.select(*keys).distinct(), keys, "left_anti").withColumn("id", F.concat(F.lit(label), F.col("id")))
    return kept.unionByName(added)


def resolve_names(asked: DataFrame, members: DataFrame) -> DataFrame:
    """Each asked name (name) with its status: ok by whole name, else by last name, else ambiguous or no_match."""
    whole = members.groupBy(linkage.normal_name(F.col("full_name")).alias("w")).agg(F.count("*").alias("wn"), F.min("voter").alias("wv"))
    last = members.groupBy(linkage.last_name(F.col("full_name")).alias("l")).agg(F.count("*").alias("ln"), F.min("voter").alias("lv"))
    rows = asked.join(whole, linkage.normal_name(F.col("name")) == F.col("w"), "left").join(last, linkage.last_name(F.col("name")) == F.col("l"), "left")
    one, two = F.col("wn") == 1, F.col("ln") == 1
    status = F.when(one | two, "ok").when(F.col("wn").isNotNull() | F.col("ln").isNotNull(), "ambiguous").otherwise("no_match")
    return rows.select(*asked.columns, F.when(one, F.col("wv")).when(two, F.col("lv")).alias("voter"), status.alias("status"))


def display_names(rows: DataFrame) -> DataFrame:
    """(voter, label) of (voter, name, chamber): the last name, with the first initial where several share it."""
    last, first = F.substring_index("name", " ", -1), F.substring("name", 1, 1)
    shared = F.count("*").over(Window.partitionBy("chamber", "__last"))
    return rows.withColumn("__last", last).select("voter", F.when(shared > 1, F.concat_ws(", ", "__last", first)).otherwise(F.col("__last")).alias("label"))


def by_district(candidates: DataFrame) -> DataFrame:
    """Of (key, district, candidate, candidate_district): a single candidate stays, of several the one of the same district."""
    n = F.count("*").over(Window.partitionBy("key"))
    rows = candidates.withColumn("n", n).where("n = 1 or district = candidate_district")
    return rows.withColumn("same", F.count("*").over(Window.partitionBy("key"))).where("same = 1").select("key", "candidate", F.col("n").alias("candidates"))


def close_names(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs of (id, name) that are each other's closest by edit distance, of all pairs alike by ``least`` or more.

    A right name is cut into one part more than the edits that such a pair may have, so one part stands unchanged in
    the left name, shifted by as many places at most: the parts are joined with the left names' pieces by equality and the distance of those met
    is measured.  Different names are compared once; null and empty names are like nothing; equals go to the smaller id.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must be over 0.5: below, a part may be empty")
    edits = lambda size: F.floor((1 - least) * size + 1e-9)
    # the parts of a name of length b: number, start and length, the same on both sides
    parts = edits(F.floor(F.col("b") / least + 1e-9)) + 1
    start = F.floor(F.col("i") * F.col("b") / F.col("k"))
    size = F.floor((F.col("i") + 1) * F.col("b") / F.col("k")) - start

    def cut(df: DataFrame) -> DataFrame:
        return df.withColumn("k", parts).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).withColumns({"p": start, "s": size})

    one, two = (df.select(F.col("name").alias(f"name{n}")).where("name <> ''").distinct() for df, n in ((left, "1"), (right, "2")))
    held = cut(two.withColumn("b", F.length("name2").cast("long"))).select("name2", "b", "i", F.expr("substring(name2, int(p) + 1, int(s))").alias("part"))
    sized = one.withColumn("a", F.length("name1").cast("long"))
    met = cut(sized.withColumn("b", F.explode(F.sequence(F.ceil(F.col("a") * least - 1e-9), F.floor(F.col("a") / least + 1e-9)))))
    shift = edits(F.greatest("a", "b"))
    met = met.withColumns({"lo": F.greatest(F.lit(0), F.col("p") - shift), "hi": F.least(F.col("a") - F.col("s"), F.col("p") + shift)}).where("lo <= hi")
    met = met.withColumn("at", F.explode(F.sequence("lo", "hi"))).select("name1", "b", "i", F.expr("substring(name1, int(at) + 1, int(s))").alias("part"))
    pairs = met.distinct().join(held, ["b", "i", "part"]).select("name1", "name2").distinct()
    same = 1 - F.levenshtein("name1", "name2") / F.greatest(F.length("name1"), F.length("name2"))
    pairs = pairs.withColumn("similarity", F.round(same, 9)).where(F.col("similarity") >= least)
    pairs = pairs.join(left.select(F.col("id").alias("id1"), F.col("name").alias("name1")), "name1").join(right.select(F.col("id").alias("id2"), F.col("name").alias("name2")), "name2")
    for own, other in (("id1", "id2"), ("id2", "id1")):
        pairs = pairs.withColumn(f"at_{own}", F.row_number().over(Window.partitionBy(own).orderBy(F.desc("similarity"), other)))
    return pairs.where("at_id1 = 1 and at_id2 = 1").select("id1", "id2", "similarity")


def tally_matches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of (id, keys, yea, nay): of equal keys where they are unique, else of equal tallies in order of id."""
    a, b = (df.withColumn("n", F.count("*").over(Window.partitionBy(*keys))) for df in (left, right))
    x, y = (df.select(F.col("id").alias(k), *keys, F.col("n").alias(f"n_{k}"), "yea", "nay") for df, k in ((a, "one"), (b, "two")))
    whole = x.where("n_one = 1").drop("yea", "nay").join(y.where("n_two = 1").drop("yea", "nay"), keys).select("one", "two", F.lit("key").alias("by"))
    rest = [df.join(whole, k, "left_anti").withColumn("i", F.row_number().over(Window.partitionBy(*keys, "yea", "nay").orderBy(k))) for df, k in ((x, "one"), (y, "two"))]
    tallied = rest[0].join(rest[1], [*keys, "yea", "nay", "i"]).select("one", "two", F.lit("tally").alias("by"))
    return whole.unionAll(tallied)


def vote_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of how two sources (item, voter, choice) agree: equal, different, or in one of them only."""
    both = left.alias("x").join(right.alias("z"), ["item", "voter"], "full").select(F.col("x.choice").alias("one"), F.col("z.choice").alias("two"))
    kind = F.when(F.col("one").isNull(), "second only").when(F.col("two").isNull(), "first only").when(F.col("one") == F.col("two"), "equal").otherwise("different")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before it.

    One shuffle by key: both sides in one sorted stream, the last right row carried forward.  Of
    right rows at one time the greatest values count.
    """
    newest = right.groupBy(*keys, at).agg(F.max(F.struct(*values)).alias("__v"))
    rows = left.withColumn("__v", F.lit(None).cast(newest.schema["__v"].dataType)).withColumn("__own", F.lit(1))
    stream = rows.unionByName(newest.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    over = Window.partitionBy(*keys).orderBy(at, "__own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = stream.withColumn("__last", F.last("__v", ignorenulls=True).over(over)).where("__own = 1")
    return carried.select(*left.columns, *(F.col(f"__last.{v}").alias(v) for v in values))


def near_days(left: DataFrame, right: DataFrame, days: int = 14) -> DataFrame:
    """Pairs of (one, day) and (two, day) at most ``days`` apart, as an equality join on buckets of that width."""
    a = left.select("one", F.col("day").alias("day1"), F.floor(F.unix_date("day") / days).alias("bucket"))
    b = right.select("two", F.col("day").alias("day2"), F.explode(F.sequence(F.floor(F.unix_date("day") / days) - 1, F.floor(F.unix_date("day") / days) + 1)).alias("bucket"))
    gap = F.datediff("day2", "day1")
    return a.join(b, "bucket").where(F.abs(gap) <= days).select("one", "two", gap.alias("gap"))
