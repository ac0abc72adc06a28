r"""How often a text mentions a type, a link to its page, or one of its methods.

A count is the number of lines holding a mention: the published patterns open with ``.*`` and
so match a line at most once. Written that way they rescan a long line from every position;
the patterns below find the first mention and swallow the rest of the line, which counts the
same lines in linear time. Names are quoted and always taken literally.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(name: str) -> str:
    """The name as a pattern that matches it literally."""
    return r"\Q" + name.replace(r"\E", r"\E\\E\Q") + r"\E"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def type_mentions(text: Column, qualified_name: str) -> Column:
    """Lines naming the type as a whole word, case ignored."""
    word = r"[\p{L}\p{N}_]"
    return _count(text, rf"(?i)(?<!{word}){quote(qualified_name)}(?!{word}).*")


def simple_name_mentions(text: Column, name: str) -> Column:
    """Lines using the bare type name in running text: after a word, sentence end or bracket."""
    before = r"(?:^|[a-z] |[.!?] |[(<])"
    after = r"(?:[>).,!?$]| [a-z])"
    return _count(text, before + quote(name) + after + ".*")


def link_mentions(html: Column, package: str, name: str) -> Column:
    """Lines with an anchor whose target holds ``package/name.html``."""
    steps = ("<a", "href", f"{package}/{name}.html", ">", "</a>")
    # Each step takes its earliest place and never gives it back: one pass over the line.
    return _count(html, "(?m)^" + "".join(f"(?>.*?{quote(step)})" for step in steps) + ".*")


def method_mentions(text: Column, class_name: str, method: str) -> Column:
    """Lines calling ``Class.method``."""
    return _count(text, rf"{quote(class_name)}\.{quote(method)}[(| ].*")
