"""Lexers: text in, one row per token out.

``text_tokens`` is the plain-text lexer as Column expressions: no Python and no
shuffle, the token number is its place in the row's own array. ``code_tokens``
is the kernel for programming languages; it sees strings, comments, directives
and nesting in one pass over each file. ``html_tokens`` adds tag pairing,
``python_blocks`` indentation. All give the columns of ``TOKENS``.

A token is identified by (fid, seq); seq is dense and 0-based in each file. Text
is lexed by code points: a non-ASCII character is a token of its own. A null
text is an empty file; a null fid is a file of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENS = T.StructType(
    [
        T.StructField("fid", T.LongType()), T.StructField("fnm", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("lnr", T.IntegerType()),
        T.StructField("txt", T.StringType()), T.StructField("typ", T.StringType()), T.StructField("len", T.IntegerType()),
        T.StructField("curly", T.IntegerType()), T.StructField("round", T.IntegerType()), T.StructField("bracket", T.IntegerType()),
        T.StructField("jmp", T.LongType()), T.StructField("bound", T.LongType()), T.StructField("mark", T.IntegerType()), T.StructField("fct", T.StringType()),
    ]
)
WORDS = r"[A-Za-z0-9_]+|[^ \t\r\n\f\x0bA-Za-z0-9_]"
LANGUAGES = ("c", "cpp", "java", "ada", "python")

#: type -> languages -> words
_WORD_LISTS = {
    "storage": {"c": "register static extern auto"},
    "modifier": {"c": "short long unsigned signed"},
    "qualifier": {"c": "volatile const"},
    "type": {
        "c": "void int char float double uint FILE",
        "cpp": "wchar_t uchar_t " + " ".join(f"{u}int{n}_t" for n in (8, 16, 32, 64) for u in ("", "u")) + " " + " ".join(f"char{n}_t" for n in (8, 16, 32)),
    },
    "specifier": {"cpp": "noexcept", "cpp ada java": "protected private", "cpp java": "public"},
    "key": {
        "c": "if else for while do switch case default break continue goto return sizeof typedef struct union enum",
        "c python": "elif",
        "cpp": "true false nullptr bool virtual explicit friend inline mutable namespace operator using typename typeid template thread_local alignas alignof asm export delete constexpr concept requires decltype "
        "static_assert static_cast const_cast dynamic_cast reinterpret_cast bitand bitor compl and_eq or_eq not_eq xor_eq",
        "ada": "when with use until type then terminate task tagged subtype some separate select reverse requeue renames rem record range procedure overriding out others of null mod loop limited generic function exit "
        "exception entry end elsif digits delta delay declare constant body begin at array all aliased access accept abs abort",
        "python": "def del lambda pass print exec except from global",
        "ada python": "in is raise",
        "ada java": "synchronized package interface abstract",
        "cpp ada python": "xor or not and",
        "cpp java": "throw this catch",
        "cpp java python": "try class",
        "cpp ada java": "new",
        "java python": "import finally assert",
        "java": "transient throws super strictfp native instanceof implements final extends byte boolean",
    },
}


def keywords(language: str = "c") -> dict[str, str]:
    """Word -> type. C++ and Java, Python and Ada know the words of their own lists; C++ those of C as well."""
    if language not in LANGUAGES:
        raise ValueError(f"no such language: {language}")
    own = {"c": {"c"}, "cpp": {"c", "cpp"}, "java": {"java"}, "python": {"python"}, "ada": {"ada"}}[language]
    return {w: typ for typ, lists in _WORD_LISTS.items() for names, words in lists.items() if own & {*names.split()} for w in words.split()}


def keyword_table(spark) -> DataFrame:
    """The static table (txt, lang, typ), for joins."""
    return spark.createDataFrame(sorted({(w, lang, typ) for lang in LANGUAGES for w, typ in keywords(lang).items()}), "txt string, lang string, typ string")


def lines(files: DataFrame) -> DataFrame:
    """(fid, fnm, lnr, line)."""
    return files.select("fid", "fnm", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lnr", "line")).withColumn("lnr", F.col("lnr") + 1)


def text_tokens(files: DataFrame) -> DataFrame:
    """The text lexer: (fid, fnm, seq, lnr, txt), of maximal word runs and single other characters."""
    by_line = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: F.transform(F.regexp_extract_all(line, F.lit(WORDS), F.lit(0)), lambda t: F.struct((i + 1).cast("int").alias("lnr"), t.alias("txt"))))
    out = files.select("fid", "fnm", F.posexplode(F.flatten(by_line)).alias("seq", "t"))
    return out.select("fid", "fnm", F.col("seq").cast("long").alias("seq"), "t.lnr", "t.txt")


def with_defaults(tokens: DataFrame) -> DataFrame:
    """Fill up to the columns of TOKENS: no types, no nesting, no marks."""
    have = {*tokens.columns}
    fill = {"typ": F.lit(""), "len": F.length("txt"), "curly": F.lit(0), "round": F.lit(0), "bracket": F.lit(0), "mark": F.lit(0)}
    return tokens.select(*[(F.col(f.name) if f.name in have else fill.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in TOKENS])


def number_type(txt: Column) -> Column:
    """The class of a numeric token, by its form; null of others."""
    t = F.regexp_replace(F.lower(txt), "'", "")
    return (
        F.when(t.rlike(r"^0x[0-9a-f]+[ul]*$"), "const_hex").when(t.rlike(r"^0b[01]+[ul]*$"), "const_bin").when(t.rlike(r"^0[0-7]+[ul]*$"), "const_oct")
        .when(t.rlike(r"^[0-9]+[ul]*$"), "const_int").when(t.rlike(r"^([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=e))(e[+-]?[0-9]+)?[fl]*$"), "const_flt")
    )


def nested(tokens: DataFrame) -> DataFrame:
    """Adds curly, round, bracket and jmp, by windows over each file.

    The depth of a token is what it was before it; inside of an opener it is one
    more; a closer carries its opener's. Depths never fall below 0: a closer
    without an opener has no partner.
    """
    w = Window.partitionBy("fid").orderBy("seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("fid", "_kind", "_depth").orderBy("seq")
    out = tokens.drop("curly", "round", "bracket", "jmp")
    depth = {}
    for name, opener, closer in (("curly", "{", "}"), ("round", "(", ")"), ("bracket", "[", "]")):
        out = out.withColumn(f"_{name}", F.sum(F.when(F.col("txt") == opener, 1).when(F.col("txt") == closer, -1).otherwise(0)).over(run))
        depth[name] = (opener, closer)
    for name, (opener, closer) in depth.items():
        low = F.least(F.lit(0), F.min(f"_{name}").over(run))
        clear = F.col(f"_{name}") - low
        # a closer at depth 0 is clamped: its depth is 0 and it closes nothing
        out = out.withColumn(f"_u{name}", (F.col("txt") == closer) & (F.col(f"_{name}") < F.coalesce(F.min(F.least(f"_{name}", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
        out = out.withColumn(name, (clear - F.when(F.col("txt") == opener, 1).otherwise(0)).cast("int"))
    out = out.withColumn("_kind", F.when(F.col("txt").isin("{", "}"), 1).when(F.col("txt").isin("(", ")"), 2).when(F.col("txt").isin("[", "]"), 3).otherwise(0))
    free = F.col("_ucurly") | F.col("_uround") | F.col("_ubracket")
    out = out.withColumn("_depth", F.when(free | (F.col("_kind") == 0), -1 - F.col("seq")).when(F.col("_kind") == 1, F.col("curly")).when(F.col("_kind") == 2, F.col("round")).otherwise(F.col("bracket")))
    opens = F.col("txt").isin("{", "(", "[")
    # in one (kind, depth), openers and closers alternate
    out = out.withColumn("jmp", F.when((F.col("_kind") > 0) & ~free, F.when(opens, F.lead("seq").over(after)).otherwise(F.lag("seq").over(after))))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


_OPERATORS = {
    "c": ["...", "<<=", ">>=", "<=", "<<", ">=", ">>", "^=", "~=", "==", "|=", "||", "&=", "&&", "+=", "++", "-=", "--", "->", "::", "!=", "*=", "%=", *"^~=<>.|&+-:!*%?"],
}
_OPERATORS["cpp"] = _OPERATORS["c"]
_OPERATORS["java"] = [">>>", *_OPERATORS["c"]]
_OPERATORS["ada"] = ["**", ":=", *_OPERATORS["c"]]
_OPERATORS["python"] = ["**=", "**", *_OPERATORS["c"]]
_DIRECTIVES = "define undef include if ifdef ifndef elif else endif error line pragma warning".split()


def _master(language: str) -> re.Pattern:
    comment = {"python": r'\#[^\n]*|"""(?:.|\n)*?(?:"""|\Z)|\'\'\'(?:.|\n)*?(?:\'\'\'|\Z)', "ada": r"--[^\n]*"}.get(language, r"/\*(?:.|\n)*?(?:\*/|\Z)|//(?:\\\n|[^\n])*")
    chars = r"'(?:\\.|[^'\\\n])*'?" if language != "ada" else r"'.'"
    ops = "|".join(re.escape(o) for o in _OPERATORS[language])
    parts = [
        rf"(?P<cmnt>{comment})",
        r'(?P<str>"(?:\\(?:.|\n)|[^"\\])*"?)',
        rf"(?P<chr>{chars})",
        r"(?P<num>(?:0[xX][0-9a-fA-F']+|0[bB][01']+|(?:[0-9][0-9']*\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[uUlLfF]*)",
        r"(?P<word>[A-Za-z_][A-Za-z0-9_]*|\$[A-Za-z0-9_]*)",
        r"(?P<splice>\\\n)",
        r"(?P<nl>\n)",
        r"(?P<white>[ \t\r\f\x0b]+)",
        r"(?P<hash>\#)" if language != "python" else r"(?!)",
        rf"(?P<oper>{ops}|/)",
        r"(?P<other>.)",
    ]
    return re.compile("|".join(parts))


def _number_type(s: str) -> str:
    t = s.lower().replace("'", "").rstrip("ul")
    if t.startswith("0x"):
        return "const_hex"
    if t.startswith("0b"):
        return "const_bin"
    if "." in t or "e" in t or t.endswith("f"):
        return "const_flt"
    return "const_oct" if len(t) > 1 and t[0] == "0" and t.isdigit() and not {*t} & {*"89"} else "const_int"


def _directive_line(text: str, at: int) -> int:
    """End of a directive that begins at ``at``: the next line end that isn't spliced."""
    while True:
        end = text.find("\n", at)
        if end < 0:
            return len(text)
        if end == 0 or text[end - 1] != "\\":
            return end
        at = end + 1


def lex(text: str, language: str = "c", macros: bool = False, eol: bool = False, eof: bool = True) -> list[tuple[int, str, str]]:
    """(line, text, type) of each token. macros: a whole directive is one token, with splices taken out."""
    known, out, line, at, directive = keywords(language), [], 1, 0, False
    indent_due = language == "python"
    depth = 0
    master = _CACHE.setdefault(language, _master(language))
    while at < len(text):
        if indent_due:
            m = re.compile(r"[ \t]*").match(text, at)
            if m[0] and text[m.end() : m.end() + 1] not in ("", "\n", "#"):
                out.append((line, m[0], "IND"))
            at, indent_due = m.end(), False
            if at >= len(text):
                break
        m = master.match(text, at)
        kind, s = m.lastgroup, m[0]
        at = m.end()
        if kind == "nl":
            if directive or eol or (language == "python" and depth == 0):
                out.append((line, "EOL", "cpp"))
            directive, indent_due = False, language == "python" and depth == 0
        elif kind == "hash":
            if macros:
                end = _directive_line(text, m.start())
                out.append((line, "# " + text[at:end].replace("\\\n", "").lstrip(), "cpp"))
                line += text.count("\n", m.start(), end)
                at = end
                continue
            word = re.compile(r"[ \t]*([A-Za-z_]+)").match(text, at)
            marker = re.compile(r'[ \t]*(?:line[ \t]+)?(\d+)[ \t]+"([^"\n]*)"[^\n]*\n?').match(text, at)
            if marker:
                out.append((int(marker[1]), marker[2], "line"))
                line, at = int(marker[1]), marker.end()
                continue
            if word and word[1] in _DIRECTIVES:
                out.append((line, "#" + word[1], "cpp"))
                at, directive = word.end(), True
            else:
                directive = True
        elif kind == "word":
            out.append((line, s, known.get(s, "ident")))
        elif kind == "num":
            out.append((line, s, _number_type(s)))
        elif kind in ("cmnt", "str", "chr", "oper"):
            out.append((line, s, kind))
        elif kind == "other":
            depth = max(0, depth + (s in "([{") - (s in ")]}"))
            out.append((line, s, ""))
        line += s.count("\n")
    if eof:
        out.append((line, "EOF", "cpp"))
    return out


_CACHE: dict = {}
_OPEN = {"{": 0, "(": 1, "[": 2}
_CLOSE = {"}": 0, ")": 1, "]": 2}


def nest(txts: list[str], typs: list[str] | None = None) -> tuple[list[tuple[int, int, int]], list[int | None]]:
    """Depths and partners of a file's tokens; #else and #elif go back to the depths at their #if."""
    depth, stacks, saved = [0, 0, 0], ([], [], []), []
    depths, jmp = [], [None] * len(txts)
    for i, t in enumerate(txts):
        k = _CLOSE.get(t)
        if k is not None:
            if stacks[k]:
                o = stacks[k].pop()
                jmp[o], jmp[i] = i, o
            depth[k] = len(stacks[k])
        elif t[:1] == "#":
            if t in ("#if", "#ifdef", "#ifndef"):
                saved.append([list(s) for s in stacks])
            elif t in ("#else", "#elif") and saved:
                stacks = tuple(list(s) for s in saved[-1])
                depth = [len(s) for s in stacks]
            elif t == "#endif" and saved:
                saved.pop()
        depths.append(tuple(depth))
        k = _OPEN.get(t)
        if k is not None:
            stacks[k].append(i)
            depth[k] = len(stacks[k])
    return depths, jmp


def repair(txts: list[str], typs: list[str], passes: int = 10) -> list[tuple[int, int, int]]:
    """Depths after mending unbalanced braces: where a function head shows inside of braces, all are taken as closed."""
    depths, _ = nest(txts)
    for _ in range(passes):
        bad = None
        for i in range(len(txts) - 1):
            if depths[i][0] > 0 and typs[i] == "ident" and txts[i + 1] == "(" and (i == 0 or txts[i - 1] in ("}", ";") or typs[i - 1] in ("type", "modifier", "storage", "EOL")):
                level, j = 0, i + 1
                while j < len(txts):
                    level += (txts[j] == "(") - (txts[j] == ")")
                    if level == 0:
                        break
                    j += 1
                if j + 1 < len(txts) and txts[j + 1] == "{" and typs[i - 1] in ("type",) and i > 0:
                    bad = i
                    break
        if bad is None:
            break
        off = depths[bad][0]
        depths = [(max(0, c - off), r, b) if i >= bad else (c, r, b) for i, (c, r, b) in enumerate(depths)]
    return depths


#: Tokens of one Arrow batch: what a worker holds besides the file that it reads.
BATCH = 16_384


def _code(language: str, macros: bool, eol: bool, eof: bool, typedefs: bool, headers: bool):
    def batch(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW, strict=True)], names=TOKENS.names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[] for _ in TOKENS]
        for b in it:
            for at in range(b.num_rows):
                fid, fnm, text = (b.column(i)[at].as_py() for i in range(3))
                rows, name, names = [], fnm, []
                for lnr, txt, typ in lex(text or "", language, macros, eol, eof):
                    if typ == "line":
                        name = txt
                    elif headers or not (name or "").startswith("/usr/"):
                        rows.append((lnr, txt, typ))
                        names.append(name)
                txts = [r[1] for r in rows]
                typs = [r[2] for r in rows]
                if typedefs:
                    typs = harvest(txts, typs)
                depths, jmp = nest(txts, typs)
                for i, r in enumerate(rows):
                    size = len(r[1]) + 1 if typs[i] == "IND" else len(r[1])
                    for c, v in zip(cols, (fid, names[i], i, r[0], r[1], typs[i], size, *depths[i], jmp[i], None, 0, None), strict=True):
                        c.append(v)
                    if len(cols[0]) >= BATCH:
                        yield batch(cols)
                        cols = [[] for _ in TOKENS]
        if cols[0]:
            yield batch(cols)

    return run


_ARROW = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]


def harvest(txts: list[str], typs: list[str]) -> list[str]:
    """Names that a typedef with a single name introduces are types from there to the end of its scope."""
    typs, known, depth, i = list(typs), [], 0, 0
    for i, t in enumerate(txts):
        if t == "{":
            depth += 1
        elif t == "}":
            depth = max(0, depth - 1)
            known = [k for k in known if k[1] <= depth]
        elif typs[i] == "ident" and (any(k[0] == t for k in known) or t in ("u8", "u16", "u32", "u64")):
            typs[i] = "type"
        elif t == "typedef":
            level, j = 0, i + 1
            while j < len(txts) and (level or txts[j] != ";"):
                level += (txts[j] == "{") - (txts[j] == "}")
                j += 1
            if j < len(txts) and typs[j - 1] == "ident" and "," not in txts[i:j]:
                known.append((txts[j - 1], depth))
    return typs


def code_tokens(files: DataFrame, language: str = "c", macros: bool = False, eol: bool = False, eof: bool = True, typedefs: bool = True, headers: bool = True) -> DataFrame:
    """Tokens of programming-language files (fid, fnm, text), nesting included; comments stay in the stream as ``cmnt``."""
    if language not in LANGUAGES:
        raise ValueError(f"no such language: {language}")
    return files.select(F.col("fid").cast("long").alias("fid"), F.col("fnm").cast("string").alias("fnm"), F.col("text").cast("string").alias("text")).mapInArrow(_code(language, macros, eol, eof, typedefs and language in ("c", "cpp"), headers), TOKENS)


def source_only(tokens: DataFrame) -> DataFrame:
    """The stream without comments, numbered anew; jmp follows."""
    w = Window.partitionBy("fid").orderBy("seq")
    kept = F.sum(F.when(F.col("typ") == "cmnt", 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    before = F.sum(F.when(F.col("typ") == "cmnt", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = tokens.withColumn("_new", kept).withColumn("_off", before)
    pair = Window.partitionBy("fid", F.least("seq", F.coalesce("jmp", "seq"))).orderBy("seq")
    other = F.coalesce(F.lead("_new").over(pair), F.lag("_new").over(pair))
    return numbered.where(F.col("typ") != "cmnt").withColumn("jmp", F.when(F.col("jmp").isNotNull(), other)).withColumn("seq", F.col("_new").cast("long")).drop("_new", "_off").select(*tokens.columns)


def comments_only(tokens: DataFrame) -> DataFrame:
    """The comments; ``bound`` is the number of the next source token in the stream without comments."""
    w = Window.partitionBy("fid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.sum(F.when(F.col("typ") == "cmnt", 0).otherwise(1)).over(w)
    last = F.sum(F.when(F.col("typ") == "cmnt", 0).otherwise(1)).over(Window.partitionBy("fid"))
    return tokens.withColumn("_n", nxt).withColumn("_all", last).where(F.col("typ") == "cmnt").withColumn("bound", F.when(F.col("_n") < F.col("_all"), F.col("_n").cast("long"))).select(*tokens.columns)


def prune_if_zero(tokens: DataFrame) -> DataFrame:
    """Without what stands between ``#if 0`` and its ``#endif``."""
    w = Window.partitionBy("fid").orderBy("seq")
    start = (F.col("txt") == "#if") & (F.lead("txt").over(w) == "0")
    flag = F.last(F.when(F.col("_s"), 1).when(F.col("txt") == "#endif", 0), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = F.coalesce(F.lag("_f").over(w), F.lit(0)) == 1
    out = tokens.withColumn("_s", start).withColumn("_f", F.coalesce(flag, F.lit(0))).withColumn("_g", (F.col("_f") == 1) | (ends & (F.col("txt") == "#endif")))
    return out.where(~F.col("_g")).drop("_s", "_f", "_g")


def retype(tokens: DataFrame, mapping: DataFrame) -> DataFrame:
    """typ by exact text from a (txt, typ) table; Spark broadcasts it if it is small."""
    m = mapping.select(F.col("txt").alias("_txt"), F.col("typ").alias("_typ")).dropDuplicates(["_txt"])
    return tokens.join(m, F.col("txt") == F.col("_txt"), "left").withColumn("typ", F.coalesce("_typ", "typ")).select(*tokens.columns)


def folded(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("txt", F.lower("txt"))


def without_types(tokens: DataFrame, *kinds: str) -> DataFrame:
    """The given types (type, qualifier, ...) fall back to ident."""
    return tokens.withColumn("typ", F.when(F.col("typ").isin(*kinds), "ident").otherwise(F.col("typ")))


def with_eol(tokens: DataFrame) -> DataFrame:
    """An EOL token after each line's last token; numbered anew."""
    w = Window.partitionBy("fid").orderBy("seq")
    last = F.coalesce(F.lead("lnr").over(w) != F.col("lnr"), F.lit(True))
    twice = tokens.withColumn("_last", last).withColumn("_k", F.explode(F.when(F.col("_last"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    out = twice.withColumn("txt", F.when(F.col("_k") == 1, "EOL").otherwise(F.col("txt"))).withColumn("seq", (F.row_number().over(Window.partitionBy("fid").orderBy("seq", "_k")) - 1).cast("long"))
    return out.drop("_last", "_k")


def without_eof(tokens: DataFrame) -> DataFrame:
    return tokens.where(~((F.col("txt") == "EOF") & (F.col("typ") == "cpp")))


def with_global_seq(tokens: DataFrame) -> DataFrame:
    """``gseq``, dense over all files in the order of fid: a prefix sum over the small table of file sizes.

    The sizes are hashed in each task and the tokens stream past them: a sort-merge join would hold and sort a task's tokens.
    """
    sizes = tokens.groupBy("fid").agg(F.count("*").alias("_n"))
    parts = sizes.withColumn("_b", F.floor(F.col("fid") / 65_536))
    blocks = parts.groupBy("_b").agg(F.sum("_n").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy("fid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("_in", inner).join(blocks.select("_b", "_before"), "_b").select(F.col("fid").alias("_fid"), (F.col("_in") + F.col("_before")).alias("_start"))
    return tokens.join(starts.hint("shuffle_hash"), F.col("fid") == F.col("_fid")).withColumn("gseq", F.col("_start") + F.col("seq")).drop("_fid", "_start")
