"""Column functions on words, texts and times."""

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that end a sentence, marks inside one, what may stand after a sentence's mark, and what is stripped from a word to compare it. Fixed values.
SENTENCE_MARKS, INNER_MARKS, CLOSERS = ".!?…", ",;:—–-", "»\"')]"
STRIPPED = """.!?…,;:"'»«()—–-"""
#: Line ends, of which one may stand after a word's last mark.
LINE_ENDS = "\n\r\u0085\u2028\u2029"


def ends_in(word: Column, marks: str, closers: str = "") -> Column:
    """The last character but closers is one of the marks. A regular expression, many times slower, is left for words with a line end."""
    last = lambda text: F.substring(text, -1, 1)
    bare = F.rtrim(word, F.lit(closers)) if closers else word
    escaped = lambda kind: "".join(f"\\{c}" if c in "]-" else c for c in kind)
    slow = word.rlike(f"[{escaped(marks)}]" + f"[{escaped(closers)}]*" * bool(closers) + "$")
    return F.when(last(word).isin(*LINE_ENDS), slow).otherwise(last(bare).isin(*marks))


def ends_sentence(word: Column) -> Column:
    """The last character is a sentence mark."""
    return ends_in(F.trim(word), SENTENCE_MARKS)


def closes_sentence(word: Column) -> Column:
    """As ends_sentence, but closing quotes and brackets after the mark don't count."""
    return ends_in(word, SENTENCE_MARKS, CLOSERS)


def ends_midphrase(word: Column) -> Column:
    return ends_in(F.trim(word), INNER_MARKS)


def cleaned(word: Column) -> Column:
    return F.lower(F.btrim(F.trim(word), F.lit(STRIPPED)))


def is_hanging(word: Column, hanging) -> Column:
    return cleaned(word).isin(*hanging)


@cache
def lowered_to(letters: str) -> str:
    """The characters that lower case turns into one of the letters, or into it and more."""
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and set(c.lower()) & set(letters)) + "Σ" * ("ς" in letters)


def classes(word: Column, hanging) -> dict[str, Column]:
    """ends_sentence, ends_midphrase and is_hanging by name, for use within a lambda: most words start and end with a letter, which is looked at first; only of others, and of those as short as hanging words and with the first and last letter of one, more is asked."""
    odd = F.lit("".join(dict.fromkeys(SENTENCE_MARKS + INNER_MARKS + CLOSERS + STRIPPED + LINE_ENDS + " ")))
    last, first = F.contains(odd, F.substring(word, -1, 1)), F.contains(odd, F.substring(word, 1, 1))  # true also of no character
    ends = [lowered_to("".join(sorted({w[at] for w in hanging if w}))) for at in (0, -1)]
    may = (F.char_length(word) <= max(map(len, hanging), default=0)) & F.contains(F.lit(ends[0]), F.substring(word, 1, 1)) & F.contains(F.lit(ends[1]), F.substring(word, -1, 1))
    plain = F.when(may, F.lower(word).isin(*hanging)).otherwise(F.lit(False))
    known = lambda c: F.when(word.isNotNull(), c)
    return {
        "sentence_end": known(F.when(last, ends_sentence(word)).otherwise(F.lit(False))), "midphrase": known(F.when(last, ends_midphrase(word)).otherwise(F.lit(False))),
        "hanging": known(F.when(last | first, is_hanging(word, hanging)).otherwise(plain))}


def token_estimate(text: Column) -> Column:
    """A token for each four code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4).cast("int"))


def padded_seconds(seconds: Column) -> Column:
    """Four whole digits and one decimal, rounded half to even as the binary value lies."""
    return F.call_function("format_number", seconds, F.lit("0000.0"))


def two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def clock(seconds: Column, mark: str) -> Column:
    """HH:MM:SS, the mark, and milliseconds."""
    ms = F.bround(seconds * 1000).cast("long")
    hours = F.floor(ms / 3_600_000)
    return F.concat(
        F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(mark),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def centis(seconds: Column) -> Column:
    """H:MM:SS.cc, negative times as 0."""
    # Rounded once, in an array of one; rint() rounds half to even as bround() does, without a decimal number for it.
    cs = F.array(F.rint(F.greatest(F.lit(0.0), seconds) * 100).cast("long"))
    written = lambda n: F.concat(F.floor(n / 360_000).cast("string"), F.lit(":"), two(F.floor(n / 6000) % 60), F.lit(":"), two(F.floor(n / 100) % 60), F.lit("."), two(n % 100))
    return F.get(F.transform(cs, written), F.lit(0))


def stem(name: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def run_key(source_hash: Column, preset: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source_hash, preset), 256), 1, 16)


def content_sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def partial_fingerprint(content: Column, head: int = 8 << 20, middle: int = 1 << 20, tail: int = 8 << 20) -> Column:
    """SHA-256 of a head, a middle and a tail of the content and its size (8 bytes, least first).

    The middle is centred and is taken only if it starts past the head; the tail only if it starts
    past the head or past the middle's end.
    """
    data = content.cast("binary")
    size = F.octet_length(data).cast("long")
    centre, last = F.greatest(F.lit(0), F.floor(size / 2) - middle // 2), F.greatest(F.lit(0), size - tail)
    part = lambda at, n: F.substring(data, (at + 1).cast("int"), F.lit(n))
    size_hex = F.lpad(F.hex(size), 16, "0")
    size_bytes = F.unhex(F.concat(*[F.substring(size_hex, k, 2) for k in range(15, 0, -2)]))
    none = F.unhex(F.lit(""))
    return F.sha2(F.concat(
        part(F.lit(0), head), F.when(centre > head, part(centre, middle)).otherwise(none),
        F.when((last > head) | (last > centre + middle), part(last, tail)).otherwise(none), size_bytes,
    ), 256)


def bits_per_second(rate: Column) -> Column:
    """'7M', '128k' or '900' as a number of bits a second; null for anything else."""
    number = F.regexp_extract(rate, r"^([0-9]+(?:\.[0-9]+)?)([kKmM]?)$", 1)
    unit = F.lower(F.regexp_extract(rate, r"^([0-9]+(?:\.[0-9]+)?)([kKmM]?)$", 2))
    return F.when(number != "", number.cast("double") * F.when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0))
