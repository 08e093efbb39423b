"""Text functions: names, regular expressions, hashes, encodings."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digest(value: Column, method: str = "md5", salt: str = "") -> Column:
    """Hex digest of the value with ``salt`` appended."""
    text = F.concat(value.cast("string"), F.lit(salt))
    if method == "md5":
        return F.md5(text)
    if method == "sha1":
        return F.sha1(text)
    return F.sha2(text, int(method.removeprefix("sha")))


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC with SHA-256, from the two padded digests."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    pad = lambda byte: F.lit(bytes(b ^ byte for b in raw))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def one_way_hash(value: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed), value.cast("string")), 256)


def quoted(text: Column) -> Column:
    """Text as a literal in quotes: single ones, double where it holds single ones and no double ones."""
    inner = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    single, double = text.contains("'"), text.contains('"')
    return F.when(single & ~double, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'")))


def one_way_hash_of(value: Column, kind: T.DataType, seed: str) -> Column:
    """A hash of any value: of a struct or map that of its sorted names and the hashes of their values, of a list that of its elements' hashes.

    A null is hashed as ``None``, truth as ``True`` and ``False``. A struct's fields are all there, null or not.
    """
    hashed = lambda text: F.sha2(F.concat(F.lit(seed), text), 256)
    none = hashed(F.lit("None"))
    pair = lambda k, h: F.concat(F.lit("("), k, F.lit(", '"), h, F.lit("')"))
    listed = lambda items: F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    if isinstance(kind, T.StructType):
        names = sorted(kind.fieldNames())
        pairs = F.array(*(pair(quoted(F.lit(n)), one_way_hash_of(value.getField(n), kind[n].dataType, seed)) for n in names))
        return F.when(value.isNull(), none).otherwise(hashed(listed(pairs)))
    if isinstance(kind, T.MapType):
        held = F.array_sort(F.map_entries(F.transform_values(value, lambda k, v: one_way_hash_of(v, kind.valueType, seed))))
        return F.when(value.isNull(), none).otherwise(hashed(listed(F.transform(held, lambda e: pair(quoted(e["key"]), e["value"])))))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: F.concat(F.lit("'"), one_way_hash_of(x, kind.elementType, seed), F.lit("'")))
        return F.when(value.isNull(), none).otherwise(hashed(listed(items)))
    text = F.initcap(value.cast("string")) if isinstance(kind, T.BooleanType) else value.cast("string")
    return hashed(F.coalesce(text, F.lit("None")))


def base64_ascii(value: Column) -> Column:
    """Base64 of ASCII text; other text fails."""
    return F.when(value.rlike(r"^\p{ASCII}*$"), F.base64(value.cast("binary"))).when(value.isNotNull(), F.raise_error(F.concat(F.lit("not ASCII: "), value)).cast("string"))


def base64_encode(value: Column) -> Column:
    return F.base64(value.cast("binary"))


def base64_decode(value: Column) -> Column:
    return F.decode(F.unbase64(value), "utf-8")


def search(value: Column, pattern: str) -> Column:
    """Group 1 of the first match, else the empty string."""
    if re.compile(pattern).groups < 1:
        raise ValueError("the pattern needs a group")
    return F.regexp_extract(value, pattern, 1)


def replace(value: Column, pattern: str, by: str) -> Column:
    r"""All matches replaced; ``\1`` in ``by`` names a group."""
    return F.regexp_replace(value, pattern, re.sub(r"\\(\d)", r"$\1", by.replace("$", r"\$")))


def snake(value: Column) -> Column:
    """An underscore before every capital but a first one, in lower case."""
    return F.lower(F.regexp_replace(value, "(?<!^)(?=[A-Z])", "_"))


def url_quote(value: Column) -> Column:
    """Percent-encoded but for letters, digits and ``_.-~``; a blank becomes a plus."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normal_name(value: Column) -> Column:
    """Lower case, other signs to underscores, an underscore before a leading digit."""
    name = F.regexp_replace(F.lower(value), "[^a-z0-9]", "_")
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name)


#: Letters of Greek and Cyrillic in Latin script, by the last words of their Unicode names.
GREEK = {
    "ALPHA": "a", "BETA": "v", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "i", "THETA": "th", "IOTA": "i", "KAPPA": "k", "LAMDA": "l", "MU": "m",
    "NU": "n", "XI": "x", "OMICRON": "o", "PI": "p", "RHO": "r", "SIGMA": "s", "FINAL SIGMA": "s", "TAU": "t", "UPSILON": "y", "PHI": "f", "CHI": "ch", "PSI": "ps", "OMEGA": "o",
}
CYRILLIC = {
    "A": "a", "BE": "b", "VE": "v", "GHE": "g", "DE": "d", "IE": "e", "IO": "yo", "ZHE": "zh", "ZE": "z", "I": "i", "SHORT I": "i", "KA": "k", "EL": "l", "EM": "m", "EN": "n", "O": "o", "PE": "p",
    "ER": "r", "ES": "s", "TE": "t", "U": "u", "EF": "f", "HA": "kh", "TSE": "ts", "CHE": "ch", "SHA": "sh", "SHCHA": "shch", "HARD SIGN": "", "YERU": "y", "SOFT SIGN": "", "E": "e", "YU": "yu", "YA": "ya",
}
#: Latin letters whose names hold no base letter.
LATIN = {"SHARP S": "ss", "THORN": "th", "ETH": "d", "ENG": "ng", "DOTLESS I": "i", "LONG S": "s", "KRA": "q"}


def latin(sign: str) -> str:
    """A sign in ASCII: a letter by what its Unicode name says, one without such a name by its code point, other signs as they are."""
    if sign.isascii() or not sign.isalnum():
        return sign
    name = unicodedata.name(sign, "")
    found = re.match(r"(?P<script>[A-Z]+)(?: (?P<case>CAPITAL|SMALL))?(?: LETTER| SYLLABLE)(?: SMALL)? (?P<rest>.*)", name)
    if sign.isdigit():
        return str(unicodedata.digit(sign))
    if not found:
        return f"u{ord(sign)}"
    rest = re.sub(" (WITH|PRECEDED) .*", "", found["rest"])
    tables = {"GREEK": GREEK, "CYRILLIC": CYRILLIC, "LATIN": LATIN}
    out = tables.get(found["script"], {}).get(rest, re.sub("[^A-Z0-9]", "", rest).lower())
    return out.capitalize() if found["case"] == "CAPITAL" else out


def snake_key(key: str) -> str:
    """A column name in snake case: in Latin letters, words and numbers apart, no leading digit.

    A run of other signs is one underscore, also at either end; a name of nothing else becomes empty.
    """
    name = unicodedata.normalize("NFC", key)  # marks that make up a letter belong to it
    name = "".join(latin(unicodedata.normalize("NFKD", c)[0] if unicodedata.normalize("NFKD", c)[0].isascii() else c) for c in name if not unicodedata.combining(c))
    name = re.sub("[^A-Za-z0-9]+", "_", name)
    for before, after in (("[a-z]", "[A-Z]"), ("[A-Za-z]", "[0-9]"), ("[0-9]", "[A-Za-z]")):  # where a word ends without a sign
        name = re.sub(f"(?<={before})(?={after})", "_", name)
    if name == "_":
        return ""
    return f"_{name}".lower() if name[:1].isdigit() else name.lower()


def normal_key(key: str) -> str:
    """A name fit for SQL columns."""
    name = re.sub(r"[^a-z0-9]", "_", key.lower())
    if not name.strip("_"):
        raise ValueError(f"no letters or digits in {key!r}")
    return f"_{name}" if name[0].isdigit() else name


def stream_name(value: Column) -> Column:
    """A class name as a stream name; runs of capitals stay one word."""
    # fixed values: the two patterns that class names are split by
    apart = F.regexp_replace(value, "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(apart, "([a-z0-9])([A-Z])", "$1_$2"))


def quoted_json(value: Column) -> Column:
    """Text as it is, other values as JSON in triple quotes."""
    return F.concat(F.lit('"""'), F.to_json(value), F.lit('"""'))
