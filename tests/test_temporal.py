from datetime import datetime

from colloquy.operators import phrases

REF = datetime(2023, 3, 9, 15, 47)  # a Thursday
CASES = [
    ("2023-02-14", "absolute_date", "resolved", "2023-02-14", "2023-02-14"),
    ("Feb 30, 2023", "absolute_date", "invalid", None, None),
    ("last Thursday", "relative_weekday", "resolved", "2023-03-02", "2023-03-02"),
    ("this fri", "relative_weekday", "resolved", "2023-03-10", "2023-03-10"),
    ("next thursday", "relative_weekday", "resolved", "2023-03-16", "2023-03-16"),
    ("yesterday", "relative_day", "resolved", "2023-03-08", "2023-03-08"),
    ("in the last 2 months", "relative_window", "resolved", "2023-01-09", "2023-03-09"),
    ("three weeks ago", "relative_window", "resolved", "2023-02-16", "2023-02-16"),
    ("the week before July 15, 2023", "week_point", "resolved", "2023-07-03", "2023-07-09"),
    ("this past weekend", "weekend", "resolved", "2023-03-04", "2023-03-05"),
    ("next weekend", "weekend", "resolved", "2023-03-18", "2023-03-19"),
    ("last month", "month_point", "resolved", "2023-02-01", "2023-02-28"),
    ("winter 2023", "season_point", "resolved", "2023-12-01", "2024-02-29"),
    ("last winter", "season_point", "resolved", "2022-12-01", "2023-02-28"),
    ("next year", "year_point", "resolved", "2024-01-01", "2024-12-31"),
    ("last week of May 2023", "month_week_range", "resolved", "2023-05-29", "2023-05-31"),
    ("before July 4, 2023", "boundary", "resolved", None, "2023-07-03"),
    ("since last month", "boundary", "resolved", "2023-02-01", None),
    ("a few years ago", "unknown", "resolved", "2018-03-09", "2021-03-09"),
    ("recently", "unknown", "resolved", "2023-03-02", "2023-03-09"),
    ("13 am", "absolute_time", "invalid", None, None),
    ("last night", "relative_daypart", "resolved", "2023-03-08", "2023-03-08"),
    ("in 3 hours", "relative_hour", "resolved", "2023-03-09", "2023-03-09"),
    ("tonight", "daypart_time", "resolved", "2023-03-09", "2023-03-09"),
    ("this winter", "season_point", "resolved", "2023-12-01", "2024-02-29"),
    ("next summer", "season_point", "resolved", "2023-06-01", "2023-08-31"),
    ("first week of May 2023", "month_week_range", "resolved", "2023-05-01", "2023-05-07"),
    ("the week of Feb 30, 2023", "week_point", "invalid", None, None),
    ("after Feb 30, 2023", "boundary", "partially_resolved", None, None),
    ("after last week", "boundary", "resolved", "2023-03-06", None),
    ("12:75", "absolute_time", "invalid", None, None),
]


def test_phrases(spark):
    df = spark.createDataFrame([(i, f"so {c[0]} it was", REF) for i, c in enumerate(CASES)], "id int, text string, ref timestamp")
    day = lambda x: x and x.date().isoformat()
    got = {r.id: (r.text, r.category, r.status, day(r.since), day(r.until), r.start, r.stop) for r in phrases.spans(df, "id", "text", "ref").collect()}
    assert got == {i: (*c, 3, 3 + len(c[0])) for i, c in enumerate(CASES)}


def test_longest_phrases_stay_and_words_stand_alone(spark):
    texts = ["maybe last weekend, in the last 2 weeks", "may_2023 xlast week lastweek", "😀 yesterday\n morning and Last  Night", None, "", "2023-02-14-15 2023/1/2", "in 3 hours ago", "5pm at 5 PM 5:30am"]
    df = spark.createDataFrame([(i, t, REF) for i, t in enumerate(texts)] + [(90, "today", None)], "id int, text string, ref timestamp")
    got = {}
    for r in phrases.spans(df, "id", "text", "ref").orderBy("id", "n").collect():
        got.setdefault(r.id, []).append((r.text, r.start, r.category))
    assert got[0] == [("last weekend", 6, "weekend"), ("in the last 2 weeks", 20, "relative_window")] and 1 not in got
    assert got[2] == [("yesterday\n morning", 2, "relative_daypart"), ("Last  Night", 25, "relative_daypart")] and 3 not in got and 4 not in got and 90 not in got
    assert [x[0] for x in got[5]] == ["2023-02-14", "2023/1/2"] and [x[0] for x in got[6]] == ["in 3 hours"] and [x[0] for x in got[7]] == ["5pm", "at 5 PM", "5:30am"]


def test_rewriting(spark):
    texts = ["I met Ann last Tuesday and in May 2022", "last Tuesday at 5 pm", "nothing", None, "before July 4, 2023 and since yesterday"]
    df = spark.createDataFrame([(i, t, REF, "q") for i, t in enumerate(texts)], "id int, text string, ref timestamp, other string")
    out = {r.id: (r.question, r.augmented) for r in phrases.augmented(phrases.rewritten(df, "id", "text", "ref"), "id", "text", "ref").collect()}
    assert out[0][0] == "I met Ann on 2023-03-07 and in 2022-05"
    assert out[1][1] == "last Tuesday [DATE: 2023-03-07] at 5 pm [TIME: 2023-03-09 17:00]"
    assert out[2] == ("nothing", "nothing") and out[3] == (None, None)
    assert out[4] == (texts[4], "before July 4, 2023 [DATE: before 2023-07-04] and since yesterday [DATE: since 2023-03-08]")
    found = {r.id: (r.has_time, [(e.text, e.start, e.end) for e in r.expressions]) for r in phrases.detected(df, "id", "text", "ref").collect()}
    assert found[1] == (True, [("last Tuesday", "2023-03-07", "2023-03-07"), ("at 5 pm", "2023-03-09", "2023-03-09")]) and found[2] == (False, [])
    twice = spark.createDataFrame([(1, "Yesterday, yesterday and today", REF)], "id int, text string, ref timestamp")
    assert sorted((r.phrase, r.display) for r in phrases.hints(twice, "id", "text", "ref").collect()) == [("today", "2023-03-09"), ("yesterday", "2023-03-08")]
