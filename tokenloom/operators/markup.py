"""HTML and indentation: tags as tokens, their partners, tables, links; Python blocks."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from .windows import after, before, in_order

#: Tags that never have a closing partner.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
KNOWN = {
    *VOID, *"html head title body div span p a ul ol li dl dt dd table thead tbody tfoot tr td th caption colgroup form label button select option textarea fieldset legend h1 h2 h3 h4 h5 h6 pre code em strong b i u s sub sup small big "
    "blockquote q cite abbr address article aside footer header main nav section figure figcaption script style noscript template iframe object param video audio canvas svg map summary details time mark center font tt".split(),
}


def html_tokens(tokens: DataFrame) -> DataFrame:
    """From text tokens: names right after ``<`` or ``</`` get the type ``tag``; ``<`` gets its ``>`` as jmp, and the other way."""
    tokens = tokens if "typ" in tokens.columns else tokens.withColumn("typ", F.lit(""))
    prev, prev2 = F.lag("txt").over(in_order()), F.lag("txt", 2).over(in_order())
    out = tokens.withColumn("_p", prev).withColumn("_p2", prev2)
    tag = F.col("txt").rlike("^[A-Za-z][A-Za-z0-9]*$") & ((F.col("_p") == "<") | ((F.col("_p") == "/") & (F.col("_p2") == "<")))
    out = out.withColumn("typ", F.when(F.coalesce(tag, F.lit(False)), "tag").otherwise(F.coalesce("typ", F.lit(""))))
    close = F.min(F.when(F.col("txt") == ">", F.col("seq"))).over(after())
    opened = F.max(F.when(F.col("txt") == "<", F.col("seq"))).over(before())
    return out.withColumn("jmp", F.when(F.col("txt") == "<", close).when(F.col("txt") == ">", opened)).drop("_p", "_p2")


def tags(tokens: DataFrame) -> DataFrame:
    """(fid, seq, lnr, name, closing, empty) of each tag of html_tokens."""
    t = html_tokens(tokens).withColumn("_c", F.lag("txt").over(in_order()) == "/").withColumn("_s", F.when(F.col("txt") == ">", F.lag("txt").over(in_order()) == "/"))
    t = t.withColumn("_e", F.last("_s", ignorenulls=True).over(after()))
    return t.where("typ = 'tag'").select("fid", "seq", "lnr", F.lower("txt").alias("name"), F.col("_c").alias("closing"), (F.lower("txt").isin(*VOID) | F.coalesce("_e", F.lit(False))).alias("empty"))


def _pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    stack, rows = [], []
    fid = pdf["fid"].iloc[0]
    for r in pdf.sort_values("seq").itertuples():
        if r.closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == r.name), None)
            if at is None:
                rows.append((fid, r.name, None, r.seq, r.lnr, "closes nothing"))
                continue
            rows += [(fid, x.name, x.seq, None, x.lnr, "not closed") for x in stack[at + 1 :]]
            rows.append((fid, r.name, stack[at].seq, r.seq, stack[at].lnr, None))
            del stack[at:]
        elif not r.empty:
            stack.append(r)
    rows += [(fid, x.name, x.seq, None, x.lnr, "not closed") for x in stack]
    return pd.DataFrame(rows, columns=["fid", "name", "open_seq", "close_seq", "lnr", "problem"]).astype({"open_seq": "Int64", "close_seq": "Int64"})


def tag_pairs(tokens: DataFrame) -> DataFrame:
    """(fid, name, open_seq, close_seq, lnr, problem): tags with their partners; unclosed inner tags are problems, not lost."""
    return tags(tokens).groupBy("fid").applyInPandas(_pairs, "fid long, name string, open_seq long, close_seq long, lnr int, problem string")


def with_partners(tokens: DataFrame) -> DataFrame:
    """bound of an opening tag: its closing one."""
    p = tag_pairs(tokens).where("problem is null").select(F.col("fid").alias("_f"), F.col("open_seq").alias("_s"), "close_seq")
    h = html_tokens(tokens)
    return h.join(p, h.fid.eqNullSafe(F.col("_f")) & (F.col("seq") == F.col("_s")), "left").withColumn("bound", F.coalesce("close_seq", F.col("bound") if "bound" in h.columns else F.lit(None).cast("long"))).drop("_f", "_s", "close_seq")


def tag_counts(tokens: DataFrame) -> DataFrame:
    return tags(tokens).where("not closing").groupBy("name").agg(F.count("*").alias("n"))


def unknown_tags(tokens: DataFrame) -> DataFrame:
    return tags(tokens).where(~F.col("name").isin(*sorted(KNOWN)))


def urls(files: DataFrame) -> DataFrame:
    """(fid, url) of href and src values, from the text itself."""
    return files.select("fid", F.explode(F.regexp_extract_all("text", F.lit("""(?i)(?:href|src)[ ]*=[ ]*["']([^"']*)["']"""), F.lit(1))).alias("url"))


def table_columns(files: DataFrame) -> DataFrame:
    """(fid, row, columns): cells of each table row, colspans counted."""
    rows = files.select("fid", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?:</tr>|(?=<tr\b)|$)"), F.lit(1))).alias("row", "tr"))
    cells = F.regexp_extract_all("tr", F.lit(r"(?i)<t[dh]\b([^>]*)>"), F.lit(1))
    span = F.aggregate(F.transform(cells, lambda a: F.coalesce(F.regexp_extract(a, r"""(?i)colspan[ ]*=[ ]*["']?([0-9]+)""", 1).try_cast("int"), F.lit(1))), F.lit(0), lambda s, x: s + x)
    return rows.select("fid", "row", span.alias("columns"))


def python_blocks(lines: DataFrame) -> DataFrame:
    """(fid, lnr, indent, last): each line that ends in a colon, and the last line of its block.

    The block ends before the first later line that is indented no deeper; blank lines and comments don't count.
    """
    code = lines.where(~F.col("line").rlike(r"^[ \t]*(#.*)?$")).withColumn("indent", F.length("line") - F.length(F.ltrim(F.regexp_replace("line", "^\t+", "    "))))
    return code.select("fid", "lnr", "indent", "line").groupBy("fid").applyInPandas(_block_ends, "fid long, lnr int, indent int, last int")


def _block_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("lnr")
    rows, stack, before = [], [], None
    for r in pdf.itertuples():
        while stack and r.indent <= stack[-1][1]:
            head = stack.pop()
            rows.append((r.fid, *head, before))
        if r.line.split("#")[0].rstrip().endswith(":"):
            stack.append((r.lnr, r.indent))
        before = r.lnr
    rows += [(pdf["fid"].iloc[0], *head, before) for head in reversed(stack)]
    return pd.DataFrame(rows, columns=["fid", "lnr", "indent", "last"])


def long_lines(lines: DataFrame, most: int = 79) -> DataFrame:
    return lines.where(F.length("line") > most)


