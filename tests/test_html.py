import pytest
from pyspark.sql import functions as F

from qalink.functions import html as H

BODY = (
    '<p>See <a href="u">it</a></p><!-- <pre>no</pre> --><script>var t = "<pre>no</pre>";</script>'
    '<pre class="x"><code>List&lt;String&gt; a = &quot;x&#39;&quot;;\n\timport b;</code></pre>'
    "<code>in<b>n</b>er</code><pre>open"
)


def test_blocks(one):
    assert one(lambda h: H.block_texts(h, "pre"), h=BODY) == ["List<String> a = \"x'\";\n\timport b;", "open"]
    assert one(lambda h: H.block_texts(h, "code"), h=BODY)[1] == "inner"
    assert one(lambda h: H.block_texts(h, "em"), h=BODY) == []
    assert one(lambda h: H.joined_text(h, "em"), h=BODY) == ""


@pytest.mark.parametrize(
    "text, plain",
    [
        ("a&lt;b&gt;&amp;&quot;&apos;", "a<b>&\"'"),
        ("&amp;lt;", "&lt;"),
        ("&#233;&#xE9;&#XE9;", "ééé"),
        ("&#128512;", "😀"),
        ("&#;&#x;", "&#;&#x;"),
        ("&#00000039;&#39s&#x00000027;&#99999999999999999999;", "''s'\ufffd"),
        ("&#38;lt; &amp;#39;", "&lt; &#39;"),
        ("x &rarr; y&hellip; &eacute; &ltb &lt b &ampx;", "x → y… é &ltb < b &ampx;"),
        ("&#0;&#xD800;", "��"),
        ("a&nbsp;b &unknown;", "a b &unknown;"),
        ("", ""),
    ],
)
def test_entities(one, text, plain):
    assert one(H.decode_entities, t=text) == plain


def test_breaking_tags_separate_words_and_inline_tags_do_not(one):
    assert one(H.plain_text, m="a<br/>b<p>c</p><b>d</b>e") == "a b c de"


def test_predicates(one):
    assert one(lambda h: H.mentions_in_elements(h, "import"), h=BODY)
    assert not one(lambda h: H.mentions_in_elements(h, "import"), h="<p>import</p><code>x</code>")
    assert one(lambda h: H.mentions_in_elements(h, "import"), h="<code>important</code>")
    assert one(H.has_element, h="<A HREF='x'>y</A>")
    assert not one(H.has_element, h="<!-- <a href='x'> --><abbr>x</abbr>")


def test_names_in_prose(one):
    named = lambda t, h: H.names_in_prose(t, h, ["Gson", "JSON Path"])
    assert one(named, t="Using GSON", h="")
    assert one(named, t="", h="<p>json path</p>")
    assert not one(named, t="", h="<pre>gson</pre><code class='a'>gson</code>")
    assert one(named, t="", h='<a href="gson.html">x</a>')


def test_parser_reads_nested_and_unclosed_elements(spark):
    html = "<code>a <code>b</code> &eacute;</code><script>'<code>no</code>'</script><code>open"
    df = spark.createDataFrame([(1, html), (2, None)], "id long, html string")
    got = {r["id"]: r["blocks"] for r in H.parsed_block_texts(df, "html", "code").collect()}
    assert got == {1: ["a b é", "b", "open"], 2: []}


def test_both_readers_agree_on_flat_markup(spark):
    df = spark.createDataFrame([(BODY.replace("<pre>open", ""),)], "html string")
    both = H.parsed_block_texts(df, "html", "pre").select(H.block_texts(F.col("html"), "pre").alias("own"), "blocks")
    row = both.first()
    assert row["own"] == row["blocks"]


@pytest.mark.parametrize(
    "html, tag, blocks",
    [
        ("<li>1 < 2</li><li>x</li><li>3 > 2</li>", "li", ["1 < 2", "x", "3 > 2"]),
        ("<pre>List a = b; a < b &hellip; x &rarr; foo</pre><pre>Foo > bar</pre>", "pre", ["List a = b; a < b … x → foo", "Foo > bar"]),
        ("<code>import x", "code", ["import x"]),
        ("<div>aaa<div>bbb</div>ccc</div>", "div", ["aaa bbb ccc", "bbb"]),
        ("<code>a<code>b<code>c</code></code>d</code><code>e</code>", "code", ["abcd", "bc", "c", "e"]),
        ('<code title="a>b">x</code>', "code", ["x"]),
        ("<code>Map<String, List<T>> m; a<b</code><pre>y</pre>", "code", ["Map<String, List> m; a<b"]),
        ("<ul><li>a<li>b</ul>", "li", ["a", "b "]),
        ("<codex>no</codex><CODE\n class='x'>yes</CODE >", "code", ["yes"]),
        ("</code>a<code>b</code></code>", "code", ["b"]),
        ("<code>a\x01b</code><code>c</code>", "code", ["ab", "c"]),
        ("", "code", []),
    ],
)
def test_blocks_of_untidy_markup(one, html, tag, blocks):
    assert one(lambda h: H.block_texts(h, tag), h=html) == blocks


def test_unclosed_code_counts(one):
    assert one(lambda h: H.mentions_in_elements(h, "import"), h="<p>x</p><code>import y")
    assert one(lambda h: H.joined_text(h, "code"), h="<code>a < b</code> <code>c</code>") == "a < b c"
