"""Text, URL and byte-code functions as Column builders."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

# The stop words of the index, and those that queries drop besides.
STOP_WORDS = "a an and are as at be by for from has he in is it its many of on or that the to was were will with".split()
QUERY_STOP_WORDS = STOP_WORDS + "how must she what when where which".split()
# Grades that count as relevant, and gains by grade (others 0).
RELEVANT_GRADES = ["perfect", "excellent", "good"]
GAINS = {"perfect": 10, "excellent": 7, "good": 5, "fair": 1}
WIKI_BASE = "https://en.wikipedia.org/wiki/"
STRICT_LINK = r'<[a|A].*?href="([^ /#]*)".*?>'
RELAXED_LINK = r'href="/?([^ /#"]*)"'
CRAWL_WORDS = ["United States", "USA", "America"]
CRAWL_SKIPPED = ["Category", "Talk", "User", "File"]


# [\W_&&...] are the characters other than ASCII letters and digits: the same as [^A-Za-z0-9...], which Java's matcher takes some ten times as long for.

def index_clean(text: Column) -> Column:
    """Other than ASCII letters, digits and white space become spaces; lower case."""
    return F.lower(F.regexp_replace(text, r"[\W_&&\S]", " "))


def mining_clean(text: Column) -> Column:
    """The same characters are deleted instead."""
    return F.lower(F.regexp_replace(text, r"[\W_&&\S]", ""))


def query_clean(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r'[\W_&&[^"\s]]', "")))


def display_clean(text: Column) -> Column:
    return F.regexp_replace(text, r"[\W_&&[^ ]]", "")


def split_words(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, r"\s+"), lambda w: w != "")


def drop_stop_words(words: Column, stop: list[str] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop))


def ngrams(words: Column, n: int) -> Column:
    """All n-grams of a word array, joined by blanks."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def anchored_weight(n_words: Column, start: Column, length: int) -> Column:
    """How often the three-word buffer counts the n-gram at a start (0-based): the first word's are
    counted as the buffer fills, the last two starts never."""
    return (
        F.when(start == 0, F.greatest(F.lit(0), F.least(F.lit(3), n_words) - length + 1))
        .when(start <= n_words - 3, F.lit(1)).otherwise(F.lit(0))
    )


#: Seven-bit groups of a long.
VBYTE_GROUPS = 9


def vbyte_size(n: Column) -> Column:
    """Groups that n takes; an error for a negative n."""
    n = n.cast("long")
    size = F.lit(1)
    for i in range(1, VBYTE_GROUPS):
        size = size + (n >= F.lit(1 << 7 * i).cast("long")).cast("int")
    return F.when(n < 0, F.raise_error(F.lit("no byte code for a negative number")).cast("int")).otherwise(size)


def vbyte_encode(n: Column) -> Column:
    """Seven-bit groups, most significant first, the high bit on the last byte; an error for a negative n."""
    n = n.cast("long")
    groups = [(F.shiftright(n, 7 * i) % 128 + (0 if i else 128)).cast("int") for i in range(VBYTE_GROUPS - 1, -1, -1)]
    return F.slice(F.array(*groups), F.lit(VBYTE_GROUPS + 1) - vbyte_size(n), vbyte_size(n))


def vbyte_decode(codes: Column) -> Column:
    """The numbers of a stream of codes."""
    empty = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("n"))

    def step(acc, b):
        n = acc["n"] * 128 + b % 128
        return F.when(b >= 128, F.struct(F.array_append(acc["out"], n).alias("out"), F.lit(0).cast("long").alias("n"))).otherwise(
            F.struct(acc["out"].alias("out"), n.alias("n")))

    return F.aggregate(codes, empty, step, lambda acc: acc["out"])


_REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def unescape(text: Column) -> Column:
    """Character references resolved, each once: named ones of HTML 4 and numeric ones; a non-breaking space is a space.
    What is no reference, or names no character, stays."""
    named = {name: " " if name == "nbsp" else chr(c) for name, c in name2codepoint.items()}
    known = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    parts, refs = F.split(text, _REFERENCE), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1))

    def resolved(r: Column) -> Column:
        code = F.when(F.lower(r).startswith("#x"), F.conv(F.substr(r, F.lit(3), F.lit(8)), 16, 10)).when(r.startswith("#"), F.substr(r, F.lit(2), F.lit(10))).cast("long")
        fine = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(fine, F.when(code == 160, F.lit(" ")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        return F.coalesce(char, F.element_at(known, r), F.concat(F.lit("&"), r, F.lit(";")))

    return F.when(text.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(F.zip_with(F.transform(refs, resolved), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda c, x: F.concat(c, x)), ""))).otherwise(text)


def strip_blocks(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")


def html_text(html: Column) -> Column:
    """All visible text."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(strip_blocks(html), "<[^>]*>", " ")), r"\s+", " "))


def html_fields(html: Column) -> Column:
    """Title, infobox tables and paragraphs, in that order, all of them. A paragraph ends at the next one, at </p> or at </article>."""
    body = strip_blocks(html)
    infobox = F.array_join(F.regexp_extract_all(body, F.lit(r"""(?is)<table[^>]*class=(?:"[^"]*|'[^']*|)\binfobox\b[^>]*>(.*?)</table>"""), F.lit(1)), " ")
    pieces = F.split(body, r"(?i)<p(?:\s[^>]*)?>")
    parts = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    paragraphs = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"(?is)(</p>|</article>).*$", "")), " ")
    whole = F.concat_ws(" ", html_title(html), infobox, paragraphs)
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(whole, "<[^>]*>", " ")), r"\s+", " "))


def link_targets(html: Column, pattern: str = STRICT_LINK) -> Column:
    """Link targets line by line."""
    return F.flatten(F.transform(F.split(html, "\n"), lambda line: F.regexp_extract_all(line, F.lit(pattern), F.lit(1))))


def wiki_url(file_name: Column) -> Column:
    return F.concat(F.lit(WIKI_BASE), file_name)


def redirect_key(title: Column) -> Column:
    """A page title as the file name that it redirects to."""
    return F.lower(F.translate(F.replace(title, F.lit(" - Wikipedia, the free encyclopedia"), F.lit("")), " :", "__"))


def clean_url(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_ok(url: Column) -> Column:
    return url.rlike(r"^https?://[^\s/?#]+[^\s]*$")


def url_file(url: Column) -> Column:
    """The path below the host with / as _."""
    return F.replace(F.regexp_replace(F.regexp_replace(clean_url(url), r"\?.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?", ""), F.lit("/"), F.lit("_"))


def admin2_code(admin1: Column, admin2: Column) -> Column:
    """US.<state>.<county>, the county's number in three digits; an empty one stays empty."""
    return F.concat(F.lit("US."), admin1, F.lit("."), F.when(F.length(admin2).isin(1, 2), F.lpad(admin2, 3, "0")).otherwise(admin2))


def state_code(county_code: Column) -> Column:
    return F.substring(county_code, 1, 5)


def grade_relevant(grade: Column) -> Column:
    return F.when(F.lower(grade).isin(RELEVANT_GRADES), 1).otherwise(0)


def grade_gain(grade: Column) -> Column:
    out = F.lit(0)
    for g, gain in reversed(GAINS.items()):
        out = F.when(F.lower(grade) == g, gain).otherwise(out)
    return out


def crawl_wanted(text: Column, path: Column, words: tuple = CRAWL_WORDS) -> Column:
    """Pages about the country, other than those of the skipped name spaces."""
    about = F.lit(False)
    for w in words:
        about = about | text.contains(w)
    for w in CRAWL_SKIPPED:
        about = about & ~path.contains(w)
    return about


def in_scope(url: Column, tld: str) -> Column:
    return url.contains(tld)


def pdf_in_scope(url: Column, tld: str, host: str) -> Column:
    return url.contains(tld) & url.contains(".pdf") & url.contains(host)
