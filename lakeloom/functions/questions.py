"""Plain-language questions, as a column: what each asks for, by keywords.

Works on any number of questions at once; the rules are built-in expressions over the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import exprs as E
from . import words


def first_word(text: Column, table: dict[str, str]) -> Column:
    """The value of the first key, in the table's order, that a text has as a part."""
    out = F.lit(None).cast("string")
    for part, value in reversed(table.items()):
        out = F.when(text.contains(part), value).otherwise(out)
    return out


def top_n(text: Column) -> Column:
    """The number in ``top 5`` or ``5 largest``."""
    found = F.coalesce(F.nullif(F.regexp_extract(text, r"top\s*(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(\d+)\s*(?:best|worst|highest|lowest|largest|smallest)", 1), F.lit("")))
    return found.try_cast("int")


def mentioned(text: Column, columns: list[str]) -> Column:
    """The columns that a text names, longest names first; an underscore may be a blank."""
    ordered = sorted(columns, key=lambda c: -len(c))
    hits = [F.when(text.contains(c.lower()) | text.contains(c.lower().replace("_", " ")), c) for c in ordered]
    return F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")


def intent(text: Column, numeric: Column, categories: Column, times: Column, any_time: bool) -> Column:
    """The chart that a question asks for, from its words and the columns it names."""
    n, c, t = F.size(numeric) > 0, F.size(categories) > 0, F.size(times) > 0
    out = F.when(F.lit(False), "")
    for kind, parts in words.INTENTS:
        out = out.when(E.any_of(text, parts), kind)
    every = E.any_of(text, ("monthly", "daily", "weekly", "yearly", "quarterly"))
    return (
        out.when(E.any_of(text, words.COUNT_WORDS) & ~n, "count").when(E.any_of(text, words.BAR_WORDS), "bar").when(text.rlike(r"top\s*\d+") & c, "bar").when(text.contains(" by ") & c & n, "bar")
        .when(E.any_of(text, ("what is", "what's", "tell me", "show me the")) & n & ~c & ~t, "stat").when(every & (t | F.lit(any_time)), "time_series")
        .when(n & c, "bar").when(t & n, "time_series").when(c & ~n, "count").when(F.size(numeric) >= 2, "scatter").when(n, "histogram").otherwise("bar")
    )


def annotate(df, text_col: str, numeric: list[str], categories: list[str], times: list[str]):
    """Adds ``intent, agg, top_n, granularity, x, y`` to a table of questions."""
    low = F.lower(F.col(text_col))
    num, cat, dt = mentioned(low, numeric), mentioned(low, categories), mentioned(low, times)
    kind = intent(low, num, cat, dt, bool(times))
    default = lambda cols: F.lit(cols[0] if cols else None).cast("string")
    business = next((c for w in words.BUSINESS_NUMERIC for c in numeric if w in c.lower()), numeric[0] if numeric else None)
    y, x_cat = F.coalesce(F.get(num, F.lit(0)), F.lit(business).cast("string")), F.coalesce(F.get(cat, F.lit(0)), default(categories))
    out = df.withColumns({"intent": kind, "agg": first_word(low, words.AGGREGATES), "top_n": top_n(low), "granularity": first_word(low, words.GRANULARITIES)})
    other = F.get(F.array_except(F.array(*(F.lit(c) for c in numeric)).cast("array<string>"), F.array(y)), F.lit(0))
    x = F.when(F.col("intent") == "time_series", F.coalesce(F.get(dt, F.lit(0)), default(times))).when(F.col("intent").isin("histogram", "scatter", "stat"), y).when(F.col("intent") != "heatmap", x_cat)
    y = F.when(F.col("intent").isin("bar", "time_series"), y).when(F.col("intent") == "scatter", F.coalesce(F.get(num, F.lit(1)), other)).when(F.col("intent") == "pie", F.get(num, F.lit(0)))
    return out.withColumns({"x": x, "y": y})


#: What is said where a chart cannot be made, or a question is empty.
REPLIES = {
    "empty": "Please type a question or chart request about your data.", "time_series": "No datetime column found for a trend chart.", "pie": "No categorical column found for a pie chart.", "bar": "No categorical column found for a comparison.",
    "histogram": "No numeric column found for a distribution chart.", "scatter": "Need at least 2 numeric columns for a scatter/relationship chart.", "heatmap": "Need at least 2 numeric columns for a heatmap.", "count": "No categorical or datetime column found for a count chart.",
}


def compile_requests(df, text_col: str, numeric: list[str], categories: list[str], times: list[str], direct: bool = False):
    """Adds what each question of a table asks for: ``request`` (text, rows, distinct, stat or chart) and a chart's
    ``chart_type, x, y, color, agg, top_n, granularity, sort_by``, or a ``reply``.

    Questions about the table itself come first (``reply`` names the kind: about, summary, columns, insights, help). With
    ``direct``, a question for a number of rows or distinct values is answered by that number, and one for a measure alone by
    its scalar; else both become charts. A null question is an empty one.
    """
    names = ("request", "chart_type", "x", "y", "color", "agg", "top_n", "granularity", "sort_by", "reply")

    def step(frame, **made):
        """Columns that later steps use by name: behind a generator, so that Spark does not write each out wherever it is used."""
        return frame.select("*", F.inline(F.array(F.struct(*(c.alias(f"__{n}") for n, c in made.items())))))

    low, num, cat, dt, kind, agg, top, every = (F.col(f"__{n}") for n in ("low", "num", "cat", "dt", "kind", "agg", "top", "every"))
    made = step(df, low=F.lower(F.trim(F.coalesce(F.col(text_col), F.lit("")))))
    made = step(made, num=mentioned(low, numeric), cat=mentioned(low, categories), dt=mentioned(low, times), agg=first_word(low, words.AGGREGATES), top=top_n(low), every=first_word(low, words.GRANULARITIES))
    made = step(made, kind=intent(low, num, cat, dt, bool(times)))
    none, whole = F.lit(None).cast("string"), F.lit(None).cast("int")
    business = next((c for w in words.BUSINESS_NUMERIC for c in numeric if w in c.lower()), numeric[0] if numeric else None)
    first = lambda found, default: F.coalesce(F.get(found, F.lit(0)), F.lit(default).cast("string"))
    measure, group, time = first(num, business), first(cat, categories[0] if categories else None), first(dt, times[0] if times else None)
    second = F.coalesce(F.get(num, F.lit(1)), F.get(F.array_except(F.array(*(F.lit(c) for c in numeric)).cast("array<string>"), F.array(F.coalesce(F.get(num, F.lit(0)), F.lit(numeric[0] if numeric else None).cast("string")))), F.lit(0)))

    def chart(chart_type: str, x=none, y=none, color=none, agg=none, top=whole, granularity=none, sort=none):
        kinds = ("chart", chart_type, x, y, color, agg, top, granularity, sort, none)
        return F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(names, kinds, strict=True)))

    def other(request: str, reply=none, x=none, agg=none):
        return F.struct(F.lit(request).alias("request"), *(v.alias(n) for n, v in zip(names[1:-1], (none, x, none, none, agg, whole, none, none), strict=True)), reply.alias("reply"))

    says = lambda key: other("text", F.lit(REPLIES[key]))
    counts = measure.isNull() | F.coalesce(agg == "count", F.lit(False))
    monthly = F.coalesce(every, F.lit("monthly"))
    summed = F.coalesce(agg, F.lit("sum"))
    trend = F.when(F.lit(not times), says("time_series")).when(counts, chart("time_series", time, agg="count", granularity=monthly)).otherwise(chart("time_series", time, measure, F.get(cat, F.lit(0)), summed, granularity=monthly))
    bar = F.when(group.isNull(), says("bar")).when(counts, chart("bar", group, agg="count", top=F.coalesce(top, F.lit(15)), sort="y_desc")).otherwise(chart("bar", group, measure, agg=summed, top=F.coalesce(top, F.lit(15)), sort="y_desc"))
    pie = F.when(group.isNull(), says("pie")).when(F.size(num) > 0, chart("pie", group, measure, agg=summed, top=F.coalesce(top, F.lit(10)))).otherwise(chart("pie", group, agg="count", top=F.coalesce(top, F.lit(10))))
    histogram = F.when(measure.isNull(), says("histogram")).otherwise(chart("histogram", measure))
    scatter = F.when(F.lit(len(numeric) < 2), says("scatter")).otherwise(chart("scatter", F.coalesce(F.get(num, F.lit(0)), F.lit(numeric[0] if numeric else None).cast("string")), second))
    heatmap = F.when(F.lit(len(numeric) < 2), says("heatmap")).otherwise(chart("heatmap"))
    count = (
        F.when(F.size(dt) > 0, chart("time_series", time, agg="count", granularity=monthly)).when(group.isNotNull(), chart("bar", group, agg="count", top=F.coalesce(top, F.lit(20)), sort="y_desc"))
        .when(F.lit(bool(times)), chart("time_series", time, agg="count", granularity="monthly")).otherwise(says("count"))
    )
    stat = F.when(F.lit(bool(times)), trend).otherwise(histogram)  # a measure alone
    out = F.when(low == "", says("empty"))
    for about, parts in words.ABOUT_QUESTIONS:
        out = out.when(E.any_of(low, parts), other("text", F.lit(about)))
    out = out.when(F.arrays_overlap(F.split(low, r"\W+"), F.array(*(F.lit(w) for w in words.HELP_WORDS))), other("text", F.lit("help")))
    if direct:
        asks = E.any_of(low, words.ROW_QUESTIONS)
        out = out.when(asks & E.any_of(low, words.ROW_WORDS), other("rows")).when(asks & (F.size(cat) > 0), other("distinct", x=group))
        out = out.when(E.any_of(low, words.STAT_QUESTIONS) & (F.size(num) > 0) & (F.size(cat) == 0) & (F.size(dt) == 0), other("stat", x=measure, agg=summed))
    for key, request in (("time_series", trend), ("pie", pie), ("histogram", histogram), ("scatter", scatter), ("heatmap", heatmap), ("count", count), ("stat", stat)):
        out = out.when(kind == key, request)
    return made.select(*(F.col(c) for c in df.columns), F.inline(F.array(out.otherwise(bar))))
