"""The readable text of web pages: one scan that knows comments, scripts and quoted attributes, then blocks by density.

Everything is a column expression. One pattern is the tokenizer: at each place the first alternative that fits takes a
comment, a script or style element with all that is in it, a tag with its quoted attributes, or nothing. As the scan goes from left to right, a
`>` in an attribute, a tag in a script or a script in a comment ends nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks that stand for tags; texts that hold such control characters lose them first.
BLOCK, OPEN, CLOSE = "\x01", "\x02", "\x03"
#: Tags that do not end a block.
INLINE = "abbr|b|bdi|bdo|cite|code|data|dfn|em|font|i|img|kbd|mark|q|s|samp|small|span|strong|sub|sup|time|tt|u|var|wbr"
#: Elements whose content is no text of the page.
UNSEEN = ("script", "style", "title")


def tokenizer(possessive: str = "+") -> str:
    """What the scan takes: hidden parts, or a tag as its name and its end. Loops give nothing back, which an engine without backtracking need not say."""
    p = possessive
    rest = rf"""(?:[^>"']+{p}|"[^"]*{p}"|'[^']*{p}')*{p}"""
    hidden = [r"<!--.*?(?:-->|\z)", *(rf"<{x}(?:[\t\n\f\r /]{rest})?>.*?(?:</{x}[\t\n\f\r ]*>|\z)" for x in UNSEEN), r"<[!?][^>]*(?:>|\z)"]
    return rf"""(?is){"|".join(hidden)}|(</?[a-z][^\t\n\f\r />"']*{p}){rest}(>)"""


#: What becomes of the tags that the scan leaves, in this order.
TAGS = {r"(?i)<a>": OPEN, r"(?i)</a>": CLOSE, rf"(?i)</?(?:{INLINE})>": "", r"(?i)</?[a-z][^\t\n\f\r />\"']*>": BLOCK}
#: Fixed values of HTML: names of the commonest character references.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»", "euro": "€"}


def decoded(text: Column) -> Column:
    """Character references by name or number replaced, each once; others stay as they are. A named one needs its semicolon."""
    name = lambda p: F.regexp_extract(p, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]+);", 1)
    known = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def one(piece: Column) -> Column:
        n = name(piece)
        number = F.when(n.rlike("^#[0-9]"), F.substr(n, F.lit(2)).cast("int")).when(n.rlike("^#[xX]"), F.conv(F.substr(n, F.lit(3)), 16, 10).cast("int"))
        sound = ((number > 31) & (number < 0xD800)) | ((number > 0xDFFF) & (number < 0x110000))
        letter = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        letter = F.coalesce(F.when(n.startswith("#"), letter), F.try_element_at(known, n))
        return F.when(letter.isNotNull(), F.concat(letter, F.substr(piece, F.length(n) + 2))).otherwise(F.concat(F.lit("&"), piece))

    parts = F.split(text, "&")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " "))


def marked(html: Column) -> Column:
    """The page with what is hidden taken out, links and block tags as marks, other tags gone."""
    text = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), f"[{BLOCK}{OPEN}{CLOSE}]", "")
    text = F.regexp_replace(text, tokenizer(), "$1$2")
    for tag, mark in TAGS.items():
        text = F.regexp_replace(text, tag, mark)
    return text


def blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, block, text, n_chars, link_chars): the blocks of each page with text, numbered from 0 among all that tags part.

    `link_chars` are those within links; a link ends with its block. Nulls are empty pages, which have no block.
    """
    parts = F.split(marked(F.col(html)), BLOCK)
    rows = pages.select(F.col(page_id).alias("page_id"), F.posexplode(parts).alias("block", "raw"))
    plain = lambda c: spaced(decoded(F.regexp_replace(c, f"[{OPEN}{CLOSE}]", "")))
    links = F.array_join(F.regexp_extract_all("raw", F.lit(f"{OPEN}([^{CLOSE}]*)"), F.lit(1)), " ")
    rows = rows.select("page_id", "block", plain(F.col("raw")).alias("text"), F.length(plain(links)).alias("link_chars"))
    return rows.where("text <> ''").select("page_id", "block", "text", F.length("text").alias("n_chars"), F.least("link_chars", F.length("text")).alias("link_chars"))


def page_texts(pages: DataFrame, most_links: float = 0.5, least: int = 20, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text, n_blocks, n_kept): the blocks of each page that are content, one a line.

    A block is content if at most `most_links` of it is link text and it has `least` characters. Every page has a row, pages
    without content an empty text; rows that repeat an id are one page with all their blocks. Very long pages are taken whole.
    """
    found = blocks(pages, page_id, html)
    good = (F.col("link_chars") <= most_links * F.col("n_chars")) & (F.col("n_chars") >= least)
    lines = F.array_sort(F.collect_list(F.when(good, F.struct("block", "text"))))
    kept = found.groupBy("page_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n_blocks"), F.count_if(good).alias("n_kept"))
    every = pages.select(F.col(page_id).alias("id")).distinct()
    out = every.join(kept, F.col("id").eqNullSafe(F.col("page_id")), "left")
    return out.select(F.col("id").alias("page_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"))
