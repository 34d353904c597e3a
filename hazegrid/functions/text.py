"""Text rules for citizen reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: phrases that make a report urgent, and pollutant words
URGENT_PHRASES = ["incendie", "brûlage", "fumée noire", "dépotoir", "mbeubeuss", "hospitalisation",
                  "difficulté à respirer", "intoxication", "évacuation", "danger immédiat", "urgence", "pompiers"]
POLLUTANT_WORDS = ["fumée", "odeur", "poussière", "gaz", "pollution", "pm", "particules"]
# fixed values: characters kept besides letters, digits and spaces
DROP_PATTERN = r"[^\p{L}\p{N}_\s\.,!?'àáâãäåèéêëìíîïòóôõöùúûüçñ]"


def normalize(text: Column) -> Column:
    t = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    return F.regexp_replace(t, DROP_PATTERN, "")


def found(text: Column, words) -> Column:
    """The words contained in ``text``, in list order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def urgency(clean: Column, n_pollutants: Column, phrases=URGENT_PHRASES) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(clean, F.lit(p))
    return F.when(hit, "high").when(n_pollutants >= 2, "medium").otherwise("low")


def excerpt(text: Column, n: int = 100) -> Column:
    head = F.left(text, F.lit(n))
    return F.when(F.length(head) == n, F.concat(head, F.lit("..."))).otherwise(head)


def spaced(text: Column) -> Column:
    """Lower case, words joined by single blanks."""
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def tokens(text: Column) -> Column:
    return F.split(spaced(text), " ")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded with two spaces in front and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.try_divide(both.cast("double"), (F.size(x) + F.size(y) - both).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def pseudonym(value: Column, key: str, length: int = 32) -> Column:
    """HMAC-SHA-256 for lookups, as hex digits; equal input and key give the same result."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in k) for pad in (0x36, 0x5C))
    mac = F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), value.cast("binary")), 256))), 256)
    return F.left(mac, F.lit(length))
