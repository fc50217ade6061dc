"""Page and URL functions as column expressions of Spark's own functions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemming import let

#: Extensions of paths that aren't pages.
SKIPPED = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".pdf", ".zip", ".rar", ".7z", ".tar", ".gz", ".mp3", ".mp4", ".avi", ".mov", ".css", ".js", ".ico"]
#: What is taken out of a page, in this order, each for one space, and the patterns of links and titles.
REMOVED = ["(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?is)<!--.*?-->", "(?is)<[^>]+>"]
HREF = r"""(?is)href\s*=\s*(?:"([^"]+)"|'([^']+)'|([^\s"'<>]+))"""
TITLE = "(?is)<title[^>]*>(.*?)</title>"
SPACE = r"(?U)[\s\x1c-\x1f]+"

#: The parts of a URL: scheme, authority, path, query, fragment.
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


#: A character reference, with or without its semicolon, and one that has it.
REFERENCE = "&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"
CLOSED = REFERENCE.replace(";?", ";")


def _replaced_code(code: int) -> str | None:
    """What a browser shows for the code of a numeric reference that isn't the character itself, by the HTML standard; None for all others."""
    if code == 0 or 0xD800 <= code <= 0xDFFF:
        return "�"
    if 0x80 <= code <= 0x9F:  # meant as Windows-1252
        try:
            return bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(code)
    control = code < 0x20 and code not in (0x09, 0x0A, 0x0C, 0x0D) or code == 0x7F
    return "" if control or 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE else None


def _json_map(values: dict) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _numeric(body: Column) -> Column:
    """The character of a numeric reference, given what stands between # and the semicolon."""
    hexadecimal = body.rlike("^[xX]")
    digits = F.regexp_replace(F.regexp_replace(body, "^[xX]", ""), "^0+(?=.)", "")
    long = F.length(digits) > F.when(hexadecimal, 6).otherwise(7)
    table = {c: r for c in [*range(0x20), *range(0x7F, 0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | e for p in range(17) for e in (0xFFFE, 0xFFFF))] if (r := _replaced_code(c)) is not None}

    def character(code: Column) -> Column:
        whole = F.decode(F.unhex(F.lpad(F.hex(code), F.lit(8), F.lit("0"))), "UTF-32")
        return F.when(code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "�").otherwise(F.coalesce(F.try_element_at(_json_map(table), code.cast("string")), whole))

    return let(F.when(long, F.lit(None).cast("long")).otherwise(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("long")), character)


def _reference(found: Column, closed: bool) -> Column:
    """What a reference stands for: a name counts with its semicolon, else, unless closed, the longest beginning that is a name does; others stay as they are."""
    names = _json_map(html5)

    def named(body: Column) -> Column:
        if closed:
            return F.coalesce(F.try_element_at(names, body), found)
        shorter = F.filter(F.sequence(F.length(body), F.lit(1), F.lit(-1)), lambda n: F.map_contains_key(names, F.left(body, n)))
        return let(F.get(shorter, 0), lambda n: F.when(n.isNull(), found).otherwise(F.concat(F.element_at(names, F.left(body, n)), F.substring(body, n + 1, F.length(body)))))

    return F.when(found.startswith("&#"), _numeric(F.regexp_replace(found, "^&#|;$", ""))).otherwise(let(F.substring(found, F.lit(2), F.length(found)), named))


def unescaped(text: Column, closed: bool = False) -> Column:
    """HTML entities undone by the HTML 5 rules; texts that hold none but the most common ones take a short way.

    closed: only references that end with a semicolon are undone, so one that was cut short ("&amp" at the end of a title) stays as it is.
    """
    simple = text
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        simple = F.replace(simple, F.lit(entity), F.lit(char))
    pattern = CLOSED if closed else REFERENCE
    plain = ~text.rlike("&(?!(?:copy|middot|quot|lt|gt|nbsp|amp);)" + (pattern[1:] if closed else ""))
    # between its references a text is split by the pattern that finds them
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda kept, ref: F.concat(kept, F.when(ref.isNull(), "").otherwise(_reference(ref, closed))))
    return F.when(plain, simple).otherwise(F.array_join(parts, ""))


def collapsed(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def html_to_text(html: Column, closed: bool = False) -> Column:
    """Text of a page: scripts, styles, comments and tags out, entities undone (closed as in unescaped), white space collapsed. The title's text stays."""
    for pattern in REMOVED:
        html = F.regexp_replace(html, pattern, " ")
    return collapsed(unescaped(html, closed))


def html_title(html: Column, closed: bool = False) -> Column:
    """First title, or null; closed as in unescaped."""
    return F.when(html.rlike(TITLE), collapsed(unescaped(F.regexp_extract(html, TITLE, 1), closed)))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def normalize_url(url: Column) -> Column:
    """Trimmed http(s) URL with scheme and host in lower case, "/" for an empty path and no fragment; null for anything else."""
    u = F.trim(url)
    query = _part(u, 4)
    made = F.concat(F.lower(_part(u, 1)), F.when((_part(u, 2) == "") & _part(u, 3).rlike("^[^/]"), ":").otherwise("://"), F.lower(_part(u, 2)), F.when(_part(u, 3) == "", "/").otherwise(_part(u, 3)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(u.rlike("(?i)^https?:"), made)


def strip_query(url: Column) -> Column:
    """URL without query and fragment."""
    return F.regexp_replace(url, "[?#].*$", "")


def host(url: Column) -> Column:
    """Host in lower case, without user and port."""
    return F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), "^.*@", ""), ":.*$", "")


def domain_allowed(url: Column, allowed: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    h, out = host(url), F.lit(False)
    for d in (x.lower().strip() for x in allowed):
        out = out | (h == d) | h.endswith(f".{d}")
    return out


def extension(url: Column) -> Column:
    """Extension of the path in lower case; a name that starts with its only dot has none."""
    return F.regexp_extract(F.lower(_part(url, 3)), r"[^/.][^/]*(\.[^./]*)$", 1)


def page_like(url: Column) -> Column:
    return ~extension(url).isin(SKIPPED)


def hrefs(html: Column) -> Column:
    """Targets of all links as written: trimmed, without empty ones, fragments and scripts; repeats stay."""
    found = F.regexp_extract_all(html, F.lit(HREF), F.lit(0))
    value = lambda m: F.trim(F.regexp_replace(F.regexp_replace(m, r"(?is)^href\s*=\s*", ""), r"""^["']|["']$""", ""))
    return F.filter(F.transform(found, value), lambda h: (h != "") & ~h.startswith("#") & ~h.startswith("javascript:"))


def _resolved(segments: Column) -> Column:
    """Path of segments with dots undone, as by the generic URL syntax; a last dot leaves a slash."""
    none = F.array().cast("array<string>")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    kept = F.aggregate(segments, none, lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    last = F.element_at(segments, -1)
    path = F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def absolute(base: Column, href: Column) -> Column:
    """href resolved against base, an http(s) URL, by the generic URL syntax; null for a host whose brackets don't match."""
    clean = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def joined(h: Column) -> Column:
        scheme, site, path, query, tail = F.lower(_part(h, 1)), _part(h, 2), F.regexp_replace(_part(h, 3), ";[^/]*$", ""), F.regexp_extract(h, r"^[^?#]*(\?[^#]*)", 1), F.regexp_extract(h, "(#.*)$", 1)
        params = F.regexp_extract(_part(h, 3), "(;[^/]+)$", 1)
        start = F.concat(F.lower(_part(base, 1)), F.lit("://"), _part(base, 2))
        base_path, base_query = _part(base, 3), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
        folder = F.split(F.regexp_replace(base_path, "[^/]+$", ""), "/")
        above = F.when(base_path.endswith("/") | (base_path == ""), F.split(base_path, "/")).otherwise(F.slice(folder, F.lit(1), F.size(folder) - 1))
        under = F.concat(above, F.split(path, "/"))
        inner = F.filter(under, lambda x, i: (x != "") | (i == 0) | (i == F.size(under) - 1))
        whole = F.when(path.startswith("/"), F.split(path, "/")).otherwise(inner)
        here = F.when((path == "") & (params == ""), F.concat(start, base_path, F.when(query == "", base_query).otherwise(query), tail)).otherwise(F.concat(start, _resolved(whole), params, query, tail))
        relative = (scheme == "") | (scheme == F.lower(_part(base, 1)))
        host_ok = ~site.rlike(r"[\[\]]") | site.rlike(r"^[^\[\]]*\[[0-9A-Za-z:.]+\][^\[\]]*$")
        return F.when(~host_ok, F.lit(None).cast("string")).when(~relative, h).when(site != "", F.concat(F.lower(_part(base, 1)), F.lit(":"), F.regexp_replace(h, r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""))).otherwise(here)

    web = base.rlike("(?i)^https?://")
    # root-relative targets without dots, which most are, take a short way
    rooted = clean.rlike("^/([^/]|$)") & ~clean.rlike(r"^[^?#]*;|(^|/)\.\.?(/|$|[?#])")
    root = F.concat(_part(base, 1), F.lit("://"), _part(base, 2), clean)
    return F.when(web & rooted, root).when(web, let(clean, joined)).otherwise(F.when(clean.rlike("(?i)^https?://"), clean))


def links(base: Column, href: Column) -> Column:
    """Normalised absolute URL of a link, or null."""
    return normalize_url(absolute(base, href))


def safe_name(title: Column) -> Column:
    """Title as a file name: word characters, spaces (as underscores) and hyphens, at most 120 characters."""
    return F.left(F.regexp_replace(F.trim(F.regexp_replace(title, r"(?U)[^\w\s-]", "")), " ", "_"), F.lit(120))
