"""Text rules: names, labels, elevations and key scrubbing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "<KEY>"
# fixed values: names whose values are secret, words that may stand before an authorization's value, a URL's parameter
VENDOR_KEY = ("maxar", "api", "key")
AUTHORIZATION = ("authorization",)
SCHEMES = ("basic", "bearer", "token", "api-key", "apikey")
URL_PARAMETER = "api_key"
SHORTEST_KEY = 8
VALUE_ENDS = "&,;)]}<>\"'"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
HEX = "0123456789ABCDEFabcdef"


def norm_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def parse_elevation(raw: Column) -> Column:
    """Metres out of '1,234 m'; NULL outside -500..9000 or unreadable."""
    v = F.regexp_extract(F.regexp_replace(raw, ",", ""), r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(v.between(-500.0, 9000.0), v)


def base_stem(stem: Column) -> Column:
    """File stem without a ' (2)' copy suffix."""
    return F.regexp_replace(stem, r"\s*\(\d+\)$", "")


def event_key(stem: Column, event: Column | None = None) -> Column:
    """What counts as the same event: its recorded id, else the stem without suffixes."""
    plain = F.regexp_replace(base_stem(stem), "_3d$", "")
    ev = F.nullif(F.trim(event), F.lit("")) if event is not None else F.lit(None).cast("string")
    return F.lower(F.coalesce(ev, plain))


def date_tag(dates: Column) -> Column:
    """'2023-08-09', or the span it covers."""
    d = F.array_sort(F.array_distinct(F.filter(dates, lambda x: x.isNotNull() & (x != ""))))
    return (F.when(F.size(d) == 0, "").when(F.size(d) == 1, F.get(d, F.lit(0)))
            .otherwise(F.concat(F.get(d, F.lit(0)), F.lit("_to_"), F.element_at(d, -1))))


def scene_tag(ids: Column) -> Column:
    """One id, or first date, count and a hash of the whole set."""
    s = F.array_sort(F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != "")))
    return (F.when(F.size(s) == 0, "").when(F.size(s) == 1, F.get(s, F.lit(0)))
            .otherwise(F.concat(F.substring(F.get(s, F.lit(0)), 1, 8), F.lit("_"), F.size(s).cast("string"), F.lit("scenes_"),
                                F.substring(F.sha1(F.array_join(s, ",")), 1, 8))))


def cloud_cell(aoi_cloud: Column, scene_cloud: Column, aoi_snow: Column) -> Column:
    """'12%' over the AOI, '~40%' whole-scene, a snow mark where snow makes it a lower bound."""
    def pct(v: Column) -> Column:
        return F.concat(F.bround(v, 0).cast("bigint").cast("string"), F.lit("%"))
    return (F.when(aoi_cloud.isNotNull(), F.concat(F.when(aoi_snow >= 50.0, "❄ ").otherwise(""), pct(aoi_cloud)))
            .when(scene_cloud.isNotNull(), F.concat(F.lit("~"), pct(scene_cloud))).otherwise(""))


def _any(*choices: str) -> str:
    return "(?:" + "|".join(choices) + ")"


def _raw_or_percent(*characters: str) -> str:
    """Any of the characters as it is or percent-encoded."""
    return _any(*[x for c in characters for x in (re.escape(c), f"%{ord(c):02X}")])


def _named_value(words: tuple[str, ...], before_value: tuple[str, ...] = ()) -> tuple[str, str]:
    """Expressions of what leads to the value of a name in a header, mapping, JSON or query string, and of the value.

    The name's words may be joined or parted by one sign; a quote may close the name; an equals sign or colon follows;
    then blanks, a quote (of a bytes literal too) and one of ``before_value`` may.  The value ends at white space, at a
    quote or at a sign that ends a parameter, an item or a bracket.
    """
    quote, blanks = _raw_or_percent('"', "'"), _any(r"\s", r"\+", "%20") + "*"
    lead = "[ _-]?".join(words) + quote + "?" + blanks + _raw_or_percent("=", ":") + blanks + "(?:b?" + quote + ")?"
    if before_value:
        lead += "(?:" + _any(*before_value) + blanks.removesuffix("*") + "+)?"
    return lead, r"[^\s" + "".join(re.escape(c) if c in "]&" else c for c in VALUE_ENDS) + "]+"


def _hide_value(text: Column, words: tuple[str, ...], before_value: tuple[str, ...] = ()) -> Column:
    lead, value = _named_value(words, before_value)
    return F.regexp_replace(text, f"(?i)({lead}){value}", "$1" + REDACTED)


def _url_key() -> str:
    return URL_PARAMETER + _raw_or_percent("=") + f"[A-Za-z0-9_-]{{{SHORTEST_KEY},}}"


def strip_url_keys(text: Column, host: str | None = None) -> Column:
    """Drop key parameters from URLs, keeping the parameters around them joined; with ``host`` only from URLs on it.

    A parameter that follows takes over the question mark.  ``&amp;`` after a key belongs to the document
    around the URL and stays.  A host's subdomains count as the host.
    """
    if host is not None:
        url = r"(?i)https?://(?:[a-z0-9-]+\.)*" + re.escape(host) + r"/[^\"<\s]*"
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(url), F.lit(0)))
        longest_first = F.array_sort(found, lambda x, y: F.length(y) - F.length(x))
        return F.when(text.isNotNull(), F.aggregate(F.coalesce(longest_first, F.array().cast("array<string>")), text, lambda t, u: F.replace(t, u, strip_url_keys(u))))
    question, ampersand = _raw_or_percent("?"), _any("&amp;", _raw_or_percent("&"))
    t = F.regexp_replace(text, f"(?i)({question}){_url_key()}" + _any("%26", "&(?!amp;)"), "$1")
    return F.regexp_replace(t, f"(?i){_any(question, ampersand)}{_url_key()}", "")


def key_fingerprints(text: Column) -> Column:
    """First eight hex digits of each distinct key value's SHA-256, never the value."""
    shown = F.regexp_extract_all(text, F.lit(f"(?i){_url_key()}"), F.lit(0))
    keys = F.transform(shown, lambda k: F.regexp_replace(k, f"(?i)^{URL_PARAMETER}{_raw_or_percent('=')}", ""))
    return F.array_sort(F.array_distinct(F.transform(keys, lambda k: F.substring(F.sha2(k, 256), 1, 8))))


def key_spellings(key: Column) -> Column:
    """Every way a known key may be written, longest first: itself, percent- and form-encoded, and the UUID it is base64 of.

    A key under eight characters has none, since hiding it would mangle other text.
    """
    k = F.trim(key)
    plain = F.translate(F.regexp_replace(k, "=+$", ""), "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    uuid = F.trim(F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1"))
    uuid = F.when(uuid.rlike("^" + "-?".join(f"[0-9A-Fa-f]{{{n}}}" for n in (8, 4, 4, 4, 12)) + "$"), uuid)
    bare = F.replace(uuid, F.lit("-"), F.lit(""))
    form = F.url_encode(k)
    ways = [k, form, F.replace(form, F.lit("+"), F.lit("%20")), *(f(x) for x in (uuid, bare) for f in (lambda c: c, F.lower, F.upper))]
    ways = F.array_distinct(F.array_compact(F.array(*ways)))
    return F.when(F.length(k) >= SHORTEST_KEY, F.array_sort(ways, lambda x, y: F.length(y) - F.length(x))).otherwise(F.array().cast("array<string>"))


def _quad(*allowed: str) -> str:
    """Regular expression of the base64 digits of up to three bytes, each out of ``allowed``.

    Neighbouring digits share a byte, so they are listed in pairs, by the bits the pairs have in common.
    A missing last byte leaves bits that may be anything.
    """
    bytes_ = [sorted(map(ord, a)) for a in allowed]
    def pairs(found: set[tuple[int, int]]) -> str:
        tails: dict[str, str] = {}
        for x in sorted({x for x, _ in found}):
            ends = "".join(BASE64[y] for _, y in sorted(p for p in found if p[0] == x))
            tails[ends] = tails.get(ends, "") + BASE64[x]
        return "(?:" + "|".join(f"[{h}][{t}]" for t, h in tails.items()) + ")"
    out = []
    for high in sorted({b >> 4 for b in bytes_[1]}):
        first = {(a >> 2, (a & 3) << 4 | high) for a in bytes_[0]}
        second = [b for b in bytes_[1] if b >> 4 == high]
        if len(bytes_) == 3:
            out.append(pairs(first) + pairs({((b & 15) << 2 | c >> 6, c & 63) for b in second for c in bytes_[2]}))
        else:
            out.append(pairs(first) + "[" + "".join(BASE64[(b & 15) << 2 | k] for b in second for k in range(4)) + "]")
    return "(?:" + "|".join(out) + ")"


def _encoded(shape: list[str]) -> str:
    """Expression of the base64 form of a text given as the characters each place allows."""
    quads = [_quad(*shape[i:i + 3]) for i in range(0, len(shape), 3)]
    out, i = "", 0
    while i < len(quads):
        n = next((k for k in range(i, len(quads)) if quads[k] != quads[i]), len(quads)) - i
        out += quads[i] + (f"{{{n}}}" if n > 1 else "")
        i += n
    return out


def encoded_uuid() -> str:
    """Base64 of a UUID's text, with its dashes or as 32 digits; both alphabets spell it alike."""
    dashed = _encoded(["-" if i in (8, 13, 18, 23) else HEX for i in range(36)])
    bare = _encoded([HEX] * 32)
    inside = "[A-Za-z0-9+/_-]"
    # few places of a text begin with a digit a UUID can begin with, and a run as long as the shorter form: only these are tried
    first = "".join(sorted({BASE64[ord(c) >> 2] for c in HEX}))
    return f"(?=[{first}][A-Za-z0-9+/]{{42}})(?:(?<!{inside})(?:{dashed}|{bare})={{0,2}}(?![=A-Za-z0-9+/_-])|{dashed}|{bare})"


def redact(text: Column, key: Column | None = None) -> Column:
    """Text with vendor keys, authorization values and base64 runs that decode to a UUID hidden, and ``key`` however it is spelled.

    Built-in expressions only: whether a run decodes to a UUID is a regular expression over its digits.
    """
    if key is not None:
        text = F.aggregate(F.coalesce(key_spellings(key), F.array().cast("array<string>")), text, lambda t, k: F.replace(t, k, F.lit(REDACTED)))
    t = _hide_value(text, VENDOR_KEY)
    t = _hide_value(t, AUTHORIZATION, SCHEMES)
    return F.regexp_replace(t, encoded_uuid(), REDACTED)
