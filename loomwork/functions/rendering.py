"""Tables as text: rows, and whole small tables in several formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def format_float(value: Column) -> Column:
    """Twelve decimals without trailing zeros, but one decimal at least."""
    # Java prints the shortest text that reads back; the twelfth decimal of the true value needs arithmetic
    whole = F.floor(F.abs(value))
    parts = F.round((F.abs(value) - whole) * 1e12).cast("long")
    whole, parts = whole + F.when(parts >= 10**12, 1).otherwise(0), F.when(parts >= 10**12, 0).otherwise(parts)
    text = F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"), F.lit("."), F.lpad(parts.cast("string"), 12, "0"))
    fixed = F.regexp_replace(text, "0+$", "")
    return F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)


def canonical_floats(df: DataFrame) -> DataFrame:
    """Float columns as canonical text, the others as they are."""
    return df.select(*[format_float(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])


def _cell(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def csv_line(columns: list[str]) -> Column:
    """Fields quoted only where they must be."""
    def field(c: str) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(_cell(c), F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(_cell(c).rlike('[",\\n\\r]'), quoted).otherwise(_cell(c))

    return F.concat_ws(",", *[field(c) for c in columns])


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_line(columns: list[str]) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escape_html(_cell(c)), F.lit("</td>")) for c in columns], F.lit("</tr>"))


def escape_latex(text: Column) -> Column:
    return F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")


def latex_line(columns: list[str]) -> Column:
    return F.concat(F.concat_ws(" & ", *[escape_latex(_cell(c)) for c in columns]), F.lit(r" \\"))


def yaml_item(columns: list[str]) -> Column:
    return F.concat(*[F.concat(F.lit("- " if i == 0 else "\n  "), F.lit(f"{c}: "), _cell(c)) for i, c in enumerate(columns)])


def document(df: DataFrame, columns: list[str], order: str, form: str) -> DataFrame:
    """A small table as one text; its lines meet in one row, so it must fit a cell."""
    widths = df.agg(*[F.greatest(F.max(F.length(_cell(c))), F.lit(len(c))).alias(f"_w{i}") for i, c in enumerate(columns)])
    padded = df
    if form in ("text", "markdown"):
        padded = df.join(F.broadcast(widths))
    w = lambda i: F.col(f"_w{i}")
    pad = lambda f, text, i: f(text, w(i), F.lit(" "))
    lines = {
        "csv": lambda: csv_line(columns), "csv_body": lambda: csv_line(columns), "html": lambda: html_line(columns),
        "latex": lambda: latex_line(columns), "json": lambda: F.to_json(F.struct(*columns)), "yaml": lambda: yaml_item(columns),
        "text": lambda: F.concat_ws(" ", *[pad(F.lpad, _cell(c), i) for i, c in enumerate(columns)]),
        "markdown": lambda: F.concat(F.lit("| "), F.concat_ws(" | ", *[pad(F.rpad, _cell(c), i) for i, c in enumerate(columns)]), F.lit(" |")),
    }
    rows = padded.select(F.struct(F.col(order).alias("o"), lines[form]().alias("line")).alias("r"), *([F.col(f"_w{i}") for i in range(len(columns))] if form in ("text", "markdown") else []))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "" if form == "html" else "," if form == "json" else "\n")
    body = rows.agg(joined.alias("body"), *[F.max(f"_w{i}").alias(f"_w{i}") for i in range(len(columns)) if form in ("text", "markdown")])
    head = {
        "csv": lambda: F.lit(",".join(columns) + "\n"), "html": lambda: F.lit("<table><thead><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr></thead><tbody>"),
        "json": lambda: F.lit("["), "text": lambda: F.concat(F.concat_ws(" ", *[pad(F.lpad, F.lit(c), i) for i, c in enumerate(columns)]), F.lit("\n")),
        "latex": lambda: F.lit("\\begin{tabular}{" + "l" * len(columns) + "}\n\\toprule\n" + " & ".join(c.replace("_", "\\_") for c in columns) + " \\\\\n\\midrule\n"),
        "markdown": lambda: F.concat(F.lit("| "), F.concat_ws(" | ", *[pad(F.rpad, F.lit(c), i) for i, c in enumerate(columns)]), F.lit(" |\n|:"), F.concat_ws("|:", *[F.repeat(F.lit("-"), w(i) + 1) for i in range(len(columns))]), F.lit("|\n")),
    }
    tail = {"html": "</tbody></table>", "json": "]", "latex": "\n\\bottomrule\n\\end{tabular}"}
    return body.select(F.concat(head[form]() if form in head else F.lit(""), F.col("body"), F.lit(tail.get(form, ""))).alias("text"))
