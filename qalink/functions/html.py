"""HTML expressions that stay in the JVM, and a parser-backed variant for nested markup."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qalink.functions.binding import let
from qalink.functions.mentions import quote

#: Attributes up to the end of a tag: quotes may hold the closing sign, and no tag reaches beyond a mark.
_REST = r"""(?:[^<>"'\x01]++|"[^"\x01]*+"|'[^'\x01]*+')*+>"""
_HIDDEN = rf"(?is)<!--.*?-->|<script(?![\w-]){_REST}.*?</script\s*>|<style(?![\w-]){_REST}.*?</style\s*>"
_BREAKING_TAGS = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|"
    "main|nav|ol|p|pre|section|table|td|th|tr|ul"
)
_BREAKING = rf"(?i)</?(?:{_BREAKING_TAGS})(?![\w-]){_REST}"
#: A tag begins with a letter, a slash and a letter, or a declaration; a lone < is text.
_ANY_TAG = rf"</?[A-Za-z]{_REST}|<[!?][^>\x01]*+>"
#: Elements whose end tag may be left out: the next one of the kind ends them.
_IMPLIED_END = ("li", "p", "dt", "dd", "tr", "td", "th", "option")
# Fixed values.
_ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&"))
#: All other named references, as the standard library lists them.
_NAMED = json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")} | dict(_ENTITIES))
# Control character that separates blocks while they are cleaned as one string.
_MARK = "\u0001"


def visible(html: Column) -> Column:
    """The markup without comments, scripts and styles."""
    return F.regexp_replace(F.translate(html, _MARK, ""), _HIDDEN, "")


def elements(html: Column, tag: str) -> Column:
    """Inner markup of every ``tag`` element, in the order of the start tags.

    Nested elements are given as well as the one around them; in the outer one, the tags of the inner
    ones are gone, replaced by a blank where they break the line. An element ends at its end tag, or
    else at the end of the text; one whose end tag may be left out ends at the next of its kind.
    """
    pattern = rf"(?i)</?{tag}(?![\w-]){_REST}"
    gap = " " if re.fullmatch(_BREAKING_TAGS, tag, re.I) else ""
    none = F.array().cast("array<string>")

    def cut(text: Column) -> Column:
        return let(
            F.struct(
                F.split(text, pattern, -1).alias("pieces"),
                F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda m: ~F.startswith(m, F.lit("</"))).alias("opens"),
            ),
            lambda s: F.when(F.size(s["opens"]) == 0, none).otherwise(inner(s["pieces"], s["opens"])),
        )

    def inner(pieces: Column, opens: Column) -> Column:
        count = F.size(opens)
        starts = F.filter(F.sequence(F.lit(1), count), lambda k: F.get(opens, k - 1))

        def one(k: Column) -> Column:
            following = F.get(opens, k)
            simple = following.isNull() | ~following
            if tag.lower() in _IMPLIED_END:
                # A start tag right behind ends an element that is never closed; nested lists close theirs.
                simple = simple | (ends(k) > count)
            return F.when(simple, F.get(pieces, k)).otherwise(
                F.array_join(F.slice(pieces, k + 1, F.least(ends(k), count + 1) - k), gap)
            )

        def ends(k: Column) -> Column:
            """Number of the tag that closes the k-th, beyond the last if none does."""
            found = F.aggregate(
                F.sequence(k + 1, F.greatest(count, k + 1)),
                F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at")),
                lambda a, i: F.when((a["at"] > 0) | (i > count), a).otherwise(
                    let(
                        a["depth"] + F.when(F.get(opens, i - 1), 1).otherwise(-1),
                        lambda d: F.struct(d.alias("depth"), F.when(d == 0, i).otherwise(0).alias("at")),
                    )
                ),
            )
            return F.when(found["at"] > 0, found["at"]).otherwise(count + 1)

        return F.transform(starts, one)

    # Removing comments and scripts joins text but makes no letters: without the tag's name
    # anywhere, a text has no such element, and the scan is left to the texts that have it.
    named = F.translate(html, _MARK, "").rlike(rf"(?i){tag}")
    return F.when(named, let(visible(html), cut)).otherwise(F.when(html.isNotNull(), none))


def decode_entities(text: Column) -> Column:
    """Decode numeric and named references, each once, in one pass.

    Numeric ones may lack their semicolon and have any number of digits; of named ones only the
    everyday ones ``lt gt amp quot nbsp`` may lack it. What is no character becomes U+FFFD.
    """

    def char(digits: Column) -> Column:
        hexadecimal = F.rlike(digits, F.lit("^[xX]"))
        plain = F.regexp_replace(digits, "^[xX]?0*(?=.)", "")
        short = F.length(plain) <= F.when(hexadecimal, 6).otherwise(7)
        code = F.when(short & hexadecimal, F.conv(plain, 16, 10)).when(short, plain).cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        made = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
        return F.coalesce(made, F.lit("�"))

    def named(name: Column) -> Column:
        out = None
        for entity, sign in _ENTITIES:
            out = F.when(name == entity, sign) if out is None else out.when(name == entity, sign)
        return out.otherwise(F.element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), name))

    def decoded(piece: Column) -> Column:
        def by_number(digits: Column) -> Column:
            rest = F.regexp_replace(piece, "^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")
            return F.when(digits != "", F.concat(char(digits), rest)).otherwise(by_name())

        def by_name() -> Column:
            name = F.regexp_extract(piece, "^(?:([A-Za-z][A-Za-z0-9]*);|(lt|gt|amp|quot|nbsp)(?![A-Za-z0-9=]))", 0)
            return let(
                name,
                lambda n: F.coalesce(
                    F.when(
                        n != "",
                        F.concat(named(F.regexp_replace(n, ";$", "")), F.substring(piece, F.length(n) + 1, F.length(piece))),
                    ),
                    F.concat(F.lit("&"), piece),
                ),
            )

        return let(F.regexp_extract(piece, "^#([xX][0-9a-fA-F]+|[0-9]+);?", 1), by_number)

    def whole(t: Column) -> Column:
        return let(
            F.split(t, "&"),
            lambda pieces: F.concat(
                F.get(pieces, F.lit(0)),
                F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decoded), ""),
            ),
        )

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), whole(t)).otherwise(t))


def plain_text(markup: Column) -> Column:
    """Text of a fragment: breaking tags become blanks, other tags vanish, references are decoded."""
    spaced = F.regexp_replace(markup, _BREAKING, " ")
    return decode_entities(F.regexp_replace(spaced, _ANY_TAG, ""))


def joined_text(html: Column, tag: str, separator: str = " ") -> Column:
    """Text of all ``tag`` elements as one string; a tag cut off in one never reaches into the next."""
    return F.array_join(block_texts(html, tag), separator)


def block_texts(html: Column, tag: str) -> Column:
    """Text of each ``tag`` element."""
    blocks = elements(html, tag)
    return let(
        blocks,
        lambda b: F.when(F.size(b) > 0, F.split(plain_text(F.array_join(b, _MARK)), _MARK)).otherwise(
            F.array().cast("array<string>")
        ),
    )


def mentions_in_elements(html: Column, needle: str, tag: str = "code") -> Column:
    """Does the text of any ``tag`` element hold ``needle``? (``import`` in code, by default use)"""
    return F.contains(joined_text(html, tag), F.lit(needle))


def has_element(html: Column, tag: str = "a") -> Column:
    return visible(html).rlike(rf"(?i)<{tag}[\s/>]")


def without_elements(html: Column, tags: Sequence[str] = ("pre", "code")) -> Column:
    out = html
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?![\w-]){_REST}.*?(?:</{tag}\s*>|\z)", "")
    return out


def names_in_prose(title: Column, html: Column, names: Sequence[str]) -> Column:
    """Is a name in the title, or in the markup left once code is cut out? Case is ignored."""
    prose = F.lower(F.concat_ws(_MARK, title, without_elements(html)))
    return prose.rlike("|".join(quote(name.lower()) for name in names))


class _BlockReader(HTMLParser):
    """Collects the text of every element of one tag, nested ones included."""

    def __init__(self, tag: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.open, self.blocks, self.skipping = tag, [], [], False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skipping = True
        elif tag == self.tag:
            self.open.append(len(self.blocks))
            self.blocks.append([])
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skipping = False
        elif tag == self.tag and self.open:
            self.open.pop()

    def handle_data(self, data):
        if not self.skipping:
            for block in self.open:
                self.blocks[block].append(data)


def _read_blocks(html: str, tag: str) -> list[str]:
    reader = _BlockReader(tag)
    reader.feed(html or "")
    reader.close()
    return ["".join(block) for block in reader.blocks]


def parsed_block_texts(df: DataFrame, html: str, tag: str, output: str = "blocks") -> DataFrame:
    """:func:`block_texts` through a real parser, for nested or unclosed elements and all named references."""
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.StringType()))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{output: [_read_blocks(h, tag) for h in batch[html]]})

    return df.mapInPandas(read, schema)
