"""Phrases of time in texts: found, resolved at a reference time, rewritten and marked, in expressions.

Rules are a table of forms; each becomes one pattern that Spark runs over the texts. Of overlapping phrases the longest stays, then the
one of the higher priority. Each phrase is a row, and what it means is date arithmetic on that row. A text that many rows have is worked out once
a reference day (a reference time, if it speaks of hours), and its rows join what it means.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and numbers in phrases, hours of day parts, days of fuzzy phrases.
MONTHS = "january february march april may june july august september october november december".split()
SHORT_MONTHS = "jan feb mar apr jun jul aug sep sept oct nov dec".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
NUMBERS = "one two three four five six seven eight nine ten eleven twelve".split()
SEASONS = {"spring": 3, "summer": 6, "fall": 9, "autumn": 9, "winter": 12}
ANCHORS = {"morning": 9, "afternoon": 15, "evening": 19, "night": 21}
FUZZY = {"a few days ago": (-5, -2), "the other day": (-4, -1), "a few weeks ago": (-28, -14), "a while ago": (-14, 0), "recently": (-7, 0), "lately": (-7, 0)}

#: Words of one kind; other words in FORMS stand for themselves.
KINDS = {
    "which": ["last", "this", "next"], "edge": ["first", "last"], "weekday": [*WEEKDAYS, *(w[:3] for w in WEEKDAYS), "tues", "thur", "thurs"], "month_name": [*MONTHS, *SHORT_MONTHS],
    "season_name": list(SEASONS), "daypart": list(ANCHORS), "daytime": [a for a in ANCHORS if a != "night"], "side": ["before", "after", "of"], "bound": ["before", "after", "since"],
    "units": [u + s for u in ("day", "week", "month", "year") for s in ("", "s")], "spans": [u + s for u in ("day", "week", "year") for s in ("", "s")], "hours": ["hour", "hours"], "half": ["am", "pm"],
}
MARKS = {"yyyy": "(?<![0-9])[0-9]{4}(?![0-9])", "d": "(?<![0-9])[0-9]{1,2}(?![0-9])", "dd": "(?<![0-9])[0-9]{2}(?![0-9])", "sep": "[-/]", ",": ",", ":": ":"}
#: Parts that are built of others. _ before a part: no white space before it, ~: with or without; ? after it: may be missing.
BUILT = {"DATE": ["yyyy _sep _d _sep _d", "month_name d _,? yyyy", "d month_name yyyy"], "CLOCK": ["d _: _dd ~half?", "d ~half"]}
#: Which phrases count, in which category, with which priority.
FORMS = (
    ("boundary", 100, "bound ANY"),
    ("month_week_range", 90, "the? edge week of month_name yyyy"),
    ("absolute_date", 80, "DATE"),
    ("absolute_time", 79, "at? CLOCK"),
    ("relative_weekday", 70, "which weekday"),
    ("relative_daypart", 67, "yesterday daypart | tomorrow daytime | last night"),
    ("daypart_time", 66, "this daytime | tonight | daypart"),
    ("relative_day", 65, "this daytime | last night | tonight | today | yesterday | tomorrow"),
    ("relative_window", 60, "in the last number units"),
    ("relative_hour", 58, "in number hours | number hours ago"),
    ("relative_window", 55, "number units ago"),
    ("week_point", 50, "which week | the week side DATE"),
    ("weekend", 48, "this past weekend | which weekend"),
    ("month_point", 40, "which month | month_name yyyy"),
    ("season_point", 35, "which season_name | season_name yyyy"),
    ("year_point", 30, "which year"),
    ("unknown", 10, "recently | lately | the other day | a while ago | a few spans ago"),
)
BUILT["ANY"] = [x.strip() for kind, _, form in FORMS if kind not in ("boundary", "unknown") for x in form.split("|")]


def _word(*words: str) -> str:
    return r"(?<!\p{L})(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")(?!\p{L})"


def _part(name: str) -> str:
    if name in BUILT:
        return "(?:" + "|".join(_sequence(f.split(), False) for f in BUILT[name]) + ")"
    if name == "number":
        return "(?:(?<![0-9])[0-9]+(?![0-9])|" + _word(*NUMBERS) + ")"
    return MARKS.get(name) or _word(*KINDS.get(name, [name]))


def _sequence(parts: list[str], inside: bool) -> str:
    """A pattern of parts in order; inside: another part came before, so white space has to."""
    if not parts:
        return ""
    name = parts[0]
    one = ("" if not inside or name[0] == "_" else r"\s*" if name[0] == "~" else r"\s+") + _part(name.lstrip("_~").rstrip("?"))
    there = one + _sequence(parts[1:], True)
    return f"(?:{there}|{_sequence(parts[1:], inside)})" if name.endswith("?") else there


def _begins(parts: list[str]) -> set[str]:
    """The characters that a sequence of parts can begin with; 0 for all digits."""
    name = parts[0].lstrip("_~").rstrip("?")
    if name in BUILT:
        first = set().union(*(_begins(f.split()) for f in BUILT[name]))
    elif name in MARKS:
        first = {"0"}
    else:
        first = {w[0] for w in NUMBERS} | {"0"} if name == "number" else {w[0] for w in KINDS.get(name, [name])}
    return first | (_begins(parts[1:]) if parts[0].endswith("?") else set())


def pattern(form: str) -> str:
    """A pattern for a form in a text whose letters A to Z are small, as a phrase of its own: no letter, digit or underscore goes on at either side.
    Where no phrase can begin it fails at the first character."""
    ways = [x.split() for x in form.split("|")]
    first = "".join(sorted(set().union(*(_begins(x) for x in ways)))).replace("0", "0-9")
    return f"(?=[{first}])" + r"(?<![\p{L}\p{N}_])(?:" + "|".join(_sequence(x, False) for x in ways) + r")(?![\p{L}\p{N}_])"


PATTERNS = [pattern(form) for _, _, form in FORMS]
#: What a text without any phrase lacks.
TRIGGER = "[0-9]|" + "|".join(["last|this|next|tonight|today|yesterday|tomorrow|recently|lately|ago|other day|week", *ANCHORS, *MONTHS, *SHORT_MONTHS, *SEASONS, *NUMBERS])
#: For each form, in the order of FORMS, pieces of which a text has to hold one; where that is too little to go by, a pattern.
HOLDS = (
    ["before", "after", "since"], ["week"], "[0-9]{4}", "[0-9]", ["last", "this", "next"], ["yesterday", "tomorrow", "night"], ["night", "morning", "afternoon", "evening"], ["this", "night", "today", "yesterday", "tomorrow"],
    ["last"], ["hour"], ["ago"], ["week"], ["weekend"], "[0-9]{4}|month", list(SEASONS), ["year"], ["recently", "lately", "other", "ago"],
)
#: What matches are set apart by, and what stands in its place in texts: characters of private use, alike to all patterns.
APART, ALIKE = "\ue000", "\ue001"
_PHRASE = "array<struct<size: int, priority: int, start: int, stop: int, kind: string>>"


def phrases(rows: DataFrame, text: str, into: str = "phrases") -> DataFrame:
    """rows with the phrases of their text that do not overlap: an array of start, stop (in characters) and kind, in order. A null text has none."""
    # small letters one for one, so that places stay what they are
    low = rows.withColumn("_low", F.translate(text, ascii_uppercase + APART, ascii_lowercase + ALIKE)).withColumn("_some", F.coalesce(F.col("_low").rlike(TRIGGER), F.lit(False)))

    def may(i: int) -> Column:
        if isinstance(HOLDS[i], str):
            return F.col("_some") & F.col("_low").rlike(HOLDS[i])
        held = F.lit(False)
        for piece in HOLDS[i]:
            held = held | F.contains("_low", F.lit(piece))
        return F.col("_some") & held

    empty = F.array().cast(_PHRASE)
    # a pattern runs once over a text; split by a pattern would compile it for every row
    cut = low.withColumns({f"_m{i}": F.when(may(i), F.regexp_replace("_low", F.lit(p), F.lit(f"{APART}$0{APART}"))) for i, p in enumerate(PATTERNS)}).drop("_some")

    def found(i: int) -> Column:
        """Matches with their places: every second piece is one, and one pass adds up the lengths."""
        kind, priority, _ = FORMS[i]
        pieces = F.transform(F.split(f"_m{i}", APART, -1), lambda x, j: F.struct(F.char_length(x).alias("size"), (j % 2 == 1).alias("is")))

        def one(so_far: Column, x: Column) -> Column:
            start, stop = so_far["at"], so_far["at"] + x["size"]
            phrase = F.struct((-x["size"]).alias("size"), F.lit(-priority).alias("priority"), start.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"))
            return F.struct(stop.alias("at"), F.when(x["is"], F.array_append(so_far["list"], phrase)).otherwise(so_far["list"]).alias("list"))

        placed = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("list")), one, lambda x: x["list"])
        return F.when(F.contains(f"_m{i}", F.lit(APART)), placed).otherwise(empty)

    every = cut.withColumn("_all", F.array_sort(F.concat(*(found(i) for i in range(len(FORMS)))))).drop("_low", *(f"_m{i}" for i in range(len(FORMS))))
    apart = F.aggregate("_all", empty, lambda kept, s: F.when(F.exists(kept, lambda x: (s["start"] < x["stop"]) & (s["stop"] > x["start"])), kept).otherwise(F.array_append(kept, s)))
    chosen = F.transform(apart, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return every.withColumn(into, F.when(F.size("_all") > 0, F.array_sort(chosen)).otherwise(F.array().cast("array<struct<start: int, stop: int, kind: string>>"))).drop("_all")


def _lookup(names: dict[str, int] | list[str], word: Column) -> Column:
    pairs = names.items() if isinstance(names, dict) else ((n, i + 1) for i, n in enumerate(names))
    return F.element_at(F.create_map(*(F.lit(x) for p in pairs for x in p)), word)


def _month(word: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m[:3], i + 1))), F.substr(word, F.lit(1), F.lit(3)))


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is no such day."""
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).cast("date")


def written_date(t: Column) -> Column:
    """The day that a text in lower case names, in one of the three ways of DATE; null if it names none."""
    get = lambda p, i: F.regexp_extract(t, p, i)
    iso, month_first, day_first = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$", r"^([a-z]+) ([0-9]{1,2}) ?,? ?([0-9]{4})$", r"^([0-9]{1,2}) ([a-z]+) ([0-9]{4})$"
    number = lambda p, i: get(p, i).try_cast("int")
    return (
        F.when(t.rlike(iso), _day(number(iso, 1), number(iso, 2), number(iso, 3)))
        .when(t.rlike(month_first), _day(number(month_first, 3), _month(get(month_first, 1)), number(month_first, 2)))
        .when(t.rlike(day_first), _day(number(day_first, 3), _month(get(day_first, 2)), number(day_first, 1)))
    )


#: What the phrases of a text depend on.
SAME = ["_text", "_at"]


def _marked(rows: DataFrame, text: str, ref: str) -> DataFrame:
    """rows with their text and the time that its phrases go by: the day of the reference time, or that itself where hours are spoken of."""
    at = F.col(ref).cast("timestamp")
    return rows.withColumns({"_text": F.col(text), "_at": F.when(F.contains(F.lower(text), F.lit("hour")), at).otherwise(F.date_trunc("day", at))})


def spans(rows: DataFrame, key: str, text: str, ref: str) -> DataFrame:
    """key, n, text, start, stop, category, status, granularity, since, until, operator, display: a row a phrase, resolved at the reference time of its row; n counts them.

    status: resolved, invalid (there is no such day or time) or partially_resolved (a bound whose phrase is neither). A bound has one open end. Rows without a text or a
    reference time have no phrases. Keys need not be unique here.
    """
    marked = _marked(rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(ref).alias("_at")), "_text", "_at")
    found = marked.join(_said_in(marked), SAME)
    return found.select(F.col("_key").alias(key), "n", "text", "start", "stop", "category", "status", "granularity", "since", "until", "operator", "display")


def _said_in(marked: DataFrame) -> DataFrame:
    """The phrases of each different text and time, as in spans, with these in place of a key."""
    spark = marked.sparkSession
    different = marked.select(*SAME).filter(F.col("_text").isNotNull() & F.col("_at").isNotNull()).distinct()
    # by number, or Spark would leave few tasks to texts that are small in bytes, though long in work
    each = phrases(different.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))), "_text")
    # the outer form: before the other one Spark filters by the size of the array, with the whole search for phrases once more in that filter
    each = each.select(*SAME, F.posexplode_outer("phrases").alias("n", "_p")).filter("n is not null")
    said = F.substr(F.col("_text"), F.col("_p.start") + 1, F.col("_p.stop") - F.col("_p.start"))
    each = each.select(*SAME, "n", said.alias("text"), "_p.start", "_p.stop", F.col("_p.kind").alias("category")).withColumn("_t", F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")))
    bound = F.col("category") == "boundary"
    each = each.withColumn("operator", F.when(bound, F.substring_index("_t", " ", 1))).withColumn("_t", F.when(bound, F.regexp_replace("_t", "^[a-z]+ ", "")).otherwise(F.col("_t")))
    inner = F.lit(None).cast("string")
    for (kind, _, _), p in reversed([x for x in zip(FORMS, PATTERNS, strict=True) if x[0][0] not in ("boundary", "unknown")]):
        inner = F.when(F.col("_t").rlike(f"^{p}$"), kind).otherwise(inner)
    each = each.withColumn("_kind", F.when(bound, inner).otherwise(F.col("category")))

    t, kind, at, words = F.col("_t"), F.col("_kind"), F.col("_at"), F.split("_t", " ")
    today = at.cast("date")
    monday = F.date_sub(today, F.weekday(today))
    which, word = words[0], lambda i: F.get(words, F.lit(i))
    number_text = F.regexp_extract(t, r"\b([0-9]+|" + "|".join(NUMBERS) + r")\b", 1)
    n = F.when(number_text.rlike("^[0-9]+$"), number_text.try_cast("int")).otherwise(F.try_element_at(F.create_map(*(F.lit(x) for i, w in enumerate(NUMBERS) for x in (w, i + 1))), number_text))
    step = F.when(which.isin("last", "yesterday"), -1).when(which.isin("next", "tomorrow"), 1).otherwise(0)
    year = F.regexp_extract(t, "([0-9]{4})$", 1).try_cast("int")
    unit = F.regexp_extract(t, "(day|week|month|year)s?(?: ago)?$", 1)
    weekday = F.try_element_at(F.create_map(*(F.lit(x) for i, w in enumerate(WEEKDAYS) for x in (w[:3], i))), F.substr(word(1), F.lit(1), F.lit(3)))
    turn = lambda d: F.when(F.pmod(d, F.lit(7)) == 0, 7).otherwise(F.pmod(d, F.lit(7)))
    back = F.when(unit == "day", F.date_sub(today, n)).when(unit == "week", F.date_sub(today, n * 7)).when(unit == "month", F.add_months(today, -n)).otherwise(F.add_months(today, -n * 12))
    dated = written_date(F.regexp_replace(t, "^the week (before|after|of) ", ""))
    week = F.when(t.startswith("the week"), F.date_add(F.date_sub(dated, F.weekday(dated)), _lookup({"before": -7, "of": 0, "after": 7}, word(2)))).otherwise(F.date_add(monday, step * 7))
    weekend = F.date_add(monday, F.when(which == "last", -2).when(t.startswith("this past"), -2).when(which == "this", 5).otherwise(12))
    month = F.when(t.endswith("month"), F.add_months(F.trunc(today, "month"), step)).otherwise(_day(year, _month(which), F.lit(1)))
    of_month = _day(year, _month(F.element_at(words, -2)), F.lit(1))
    last = F.last_day(of_month)
    edge = F.regexp_extract(t, "^(?:the )?(first|last)", 1)
    season_name = F.regexp_extract(t, "(" + "|".join(SEASONS) + ")", 1)
    season_month = F.try_element_at(F.create_map(*(F.lit(x) for p in SEASONS.items() for x in p)), season_name)

    def season(y: Column) -> Column:
        first = _day(y, season_month, F.lit(1))
        return F.struct(y.alias("y"), first.alias("a"), F.date_sub(F.add_months(first, 3), 1).alias("z"))

    near = F.transform(F.sequence(F.year(today) - 2, F.year(today) + 2), season)
    seasons = (
        F.when(year.isNotNull(), season(year))
        .when(which == "last", F.array_max(F.filter(near, lambda s: s["z"] < today)))
        .when(which == "next", F.array_min(F.filter(near, lambda s: s["a"] > today)))
        .otherwise(F.coalesce(F.array_min(F.filter(near, lambda s: (s["a"] <= today) & (s["z"] >= today))), season(F.year(today))))
    )
    that_year = F.year(today) + step
    key_ = F.regexp_replace(t, "(day|week|year) ago", "$1s ago")
    fuzzy = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for k, v in FUZZY.items() for x in (k, v[i]))), key_)
    years = key_ == "a few years ago"
    pick = lambda **by: _cascade(kind, by)
    first = pick(
        absolute_date=written_date(t), relative_weekday=F.when(which == "this", F.date_add(monday, weekday)).when(which == "last", F.date_sub(today, turn(F.weekday(today) - weekday))).otherwise(F.date_add(today, turn(weekday - F.weekday(today)))),
        relative_day=F.date_add(today, step), relative_window=back, week_point=week, weekend=weekend, month_point=month, month_week_range=F.when(edge == "first", of_month).otherwise(F.greatest(of_month, F.date_sub(last, F.weekday(last)))),
        season_point=seasons["a"], year_point=F.make_date(that_year, F.lit(1), F.lit(1)), unknown=F.when(years, F.add_months(today, -60)).otherwise(F.date_add(today, fuzzy(0))),
    )
    until = pick(
        relative_window=F.when(t.startswith("in"), today).otherwise(F.col("_a")), week_point=F.date_add("_a", 6), weekend=F.date_add("_a", 1), month_point=F.last_day("_a"),
        month_week_range=F.when(edge == "first", F.date_add(of_month, 6 - F.weekday(of_month))).otherwise(last), season_point=seasons["z"], year_point=F.make_date(that_year, F.lit(12), F.lit(31)),
        unknown=F.when(years, F.add_months(today, -24)).otherwise(F.date_add(today, fuzzy(1))),
    )
    hour, minute, half = (F.regexp_extract(t, r"^(?:at )?([0-9]{1,2})(?::([0-9]{2}))? ?(am|pm)?$", i) for i in (1, 2, 3))
    h, m = hour.try_cast("int"), F.coalesce(minute.try_cast("int"), F.lit(0))
    ok = (m <= 59) & F.when(half != "", h.between(1, 12)).otherwise(h <= 23)
    clock = F.when(half == "", h).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0))
    part = F.when(t == "tonight", "night").otherwise(F.element_at(words, -1))
    hours = F.try_element_at(F.create_map(*(F.lit(x) for p in ANCHORS.items() for x in p)), part)
    later = lambda base, secs: F.timestamp_micros(F.unix_micros(base) + secs.cast("long") * 1_000_000)
    midnight = lambda d: d.cast("timestamp")
    moment = pick(
        absolute_time=F.when(ok, later(midnight(today), clock * 3600 + m * 60)), relative_daypart=later(midnight(F.date_add(today, step)), hours * 3600), daypart_time=later(midnight(F.date_add(today, step)), hours * 3600),
        relative_hour=later(at, F.when(t.startswith("in "), n).otherwise(-n) * 3600),
    )
    day_parts = kind.isin("relative_daypart", "daypart_time")
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    granularity = F.when(kind.isin("absolute_date", "relative_weekday", "relative_day"), "day").when(kind == "relative_window", F.when(t.startswith("in"), unit).otherwise("day")).when(kind.isin("week_point", "month_week_range"), "week")
    granularity = granularity.when(kind == "weekend", "weekend").when(kind == "month_point", "month").when(kind == "season_point", "season").when(kind == "year_point", "year").when(kind.isin("absolute_time", "relative_hour"), "time").otherwise("range")
    plain = F.when(F.col("_a") == F.col("_b"), iso("_a")).otherwise(F.concat(iso("_a"), F.lit(" to "), iso("_b")))
    display = F.when(kind == "week_point", F.concat(F.lit("week of "), iso("_a"))).when(kind == "weekend", F.concat(F.lit("weekend of "), iso("_a"))).when(kind == "month_point", F.date_format("_a", "yyyy-MM")).when(kind == "season_point", F.concat_ws(" ", season_name, seasons["y"].cast("string")))
    display = display.when(kind == "year_point", F.date_format("_a", "yyyy")).when(day_parts, F.concat(part, F.lit(" of "), iso("_moment"))).when(kind.isin("absolute_time", "relative_hour"), F.date_format("_moment", "yyyy-MM-dd HH:mm")).otherwise(plain)
    done = each.withColumn("_a", first).withColumn("_b", F.coalesce(until, F.col("_a"))).withColumn("_moment", moment)
    begin = F.coalesce("_moment", midnight(F.col("_a")))
    end = F.coalesce("_moment", midnight(F.date_add("_b", 1)) - F.expr("interval 1 microsecond"))
    good = begin.isNotNull()
    micro = F.expr("interval 1 microsecond")
    since = F.when(F.col("operator") == "after", end + micro).when(F.col("operator") == "before", F.lit(None).cast("timestamp")).otherwise(begin)
    stop = F.when(F.col("operator") == "before", begin - micro).when(F.col("operator").isNotNull(), F.lit(None).cast("timestamp")).otherwise(end)
    status = F.when(good, "resolved").when(F.col("operator").isNotNull(), "partially_resolved").otherwise("invalid")
    shown = F.when(F.col("operator").isNotNull(), F.concat_ws(" ", "operator", display)).otherwise(display)
    out = done.withColumns({"status": status, "granularity": F.when(good, granularity), "since": F.when(good, since), "until": F.when(good, stop), "display": F.when(good, shown)})
    return out.select(*SAME, "n", "text", "start", "stop", "category", "status", "granularity", "since", "until", "operator", "display")


def _cascade(kind: Column, by: dict[str, Column]) -> Column:
    out = None
    for name, value in by.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def _spliced(text: Column, parts: Column) -> Column:
    """A text with each part (start, stop, say; in order) in place of what stands there."""
    before = lambda i: F.coalesce(F.get(parts, i - 1)["stop"], F.lit(0))
    pieces = F.transform(parts, lambda p, i: F.concat(F.substr(text, before(i) + 1, p["start"] - before(i)), p["say"]))
    return F.concat(F.array_join(pieces, ""), F.substr(text, F.coalesce(F.element_at(parts, -1)["stop"], F.lit(0)) + 1))


def _with_parts(rows: DataFrame, marked: DataFrame, said: DataFrame, text: str, into: str) -> DataFrame:
    """said: a text and its time, start, stop, say; what says nothing (null) stays as it is. It is left out of the lists: as a filter it would be pushed below all that works out a phrase, and do that twice."""
    parts = said.groupBy(*SAME).agg(F.sort_array(F.collect_list(F.when(F.col("say").isNotNull(), F.struct("start", "stop", "say")))).alias("_parts"))
    new = parts.select(*SAME, F.when(F.size("_parts") > 0, _spliced(F.col("_text"), F.col("_parts"))).alias("_new"))
    out = marked.join(new, SAME, "left").withColumn("_new", F.coalesce("_new", F.col(text)))
    return out.select(*(F.col(c) for c in rows.columns if c != into), F.col("_new").alias(into))


#: Words after which a date needs none before it.
LEADS = "on in at by from until since before after during".split()


def rewritten(rows: DataFrame, key: str, text: str, ref: str, into: str = "question") -> DataFrame:
    """rows (unique keys) with the text in which resolved relative phrases stand as dates, with "on", "in" or "during" before them unless such a word is there. Written dates and bounds stay."""
    marked = _marked(rows, text, ref)
    led = F.substr(F.col("_text"), F.lit(1), F.col("start")).rlike(rf"(?i)\b(?:{'|'.join(LEADS)})\s+$")
    lead = F.when(led, "").when(F.col("granularity") == "day", "on ").when(F.col("granularity").isin("month", "year", "season"), "in ").when(F.col("granularity").isin("week", "weekend"), "during ").otherwise("")
    counts = (F.col("status") == "resolved") & ~F.col("category").isin("absolute_date", "boundary")
    return _with_parts(rows, marked, _said_in(marked).select(*SAME, "start", "stop", F.when(counts, F.concat(lead, "display")).alias("say")), text, into)


def augmented(rows: DataFrame, key: str, text: str, ref: str, into: str = "augmented") -> DataFrame:
    """rows (unique keys) with the text and a typed marker after each resolved phrase."""
    marked = _marked(rows, text, ref)
    kind = F.when(F.col("granularity") == "time", "TIME").when(F.col("granularity") == "day", "DATE").otherwise("TIMESPAN")
    marker = F.concat(F.lit(" ["), kind, F.lit(": "), F.col("display"), F.lit("]"))
    return _with_parts(rows, marked, _said_in(marked).select(*SAME, F.col("stop").alias("start"), "stop", F.when(F.col("status") == "resolved", marker).alias("say")), text, into)


def hints(rows: DataFrame, key: str, text: str, ref: str) -> DataFrame:
    """key, phrase, display: the first resolved phrase of each lower-case form per key, with its date."""
    first = F.min(F.when(F.col("status") == "resolved", F.struct("n", "display")))
    marked = _marked(rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(ref).alias("_at")), "_text", "_at")
    said = _said_in(marked).groupBy(*SAME, F.lower("text").alias("phrase")).agg(first.alias("_first"))
    found = marked.join(said, SAME).groupBy(F.col("_key").alias(key), "phrase").agg(F.min("_first").alias("_first")).filter("_first is not null")
    return found.select(key, "phrase", "_first.display")


def detected(rows: DataFrame, key: str, text: str, ref: str) -> DataFrame:
    """The older form: key, has_time, expressions (text, first and last day, granularity of each resolved phrase, in order), for every row (unique keys)."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    one = F.struct("n", "text", day("since").alias("start"), day("until").alias("end"), "granularity")
    marked = _marked(rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(ref).alias("_at")), "_text", "_at")
    found = _said_in(marked).groupBy(*SAME).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("status") == "resolved", one))), lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), x["granularity"].alias("granularity"))).alias("expressions"))
    out = marked.join(found, SAME, "left")
    none = F.array().cast("array<struct<text: string, start: string, end: string, granularity: string>>")
    return out.select(F.col("_key").alias(key), (F.coalesce(F.size("expressions"), F.lit(0)) > 0).alias("has_time"), F.coalesce("expressions", none).alias("expressions"))
