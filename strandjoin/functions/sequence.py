"""Scalar functions on DNA strings, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ambiguity codes of references (and the gap), which become N.
AMBIGUOUS = "BDHKMNRSVWXY-"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complement(seq: Column | str) -> Column:
    """Keeps case; anything but ACGT stays."""
    return F.translate(col(seq), "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def normalise_read(seq: Column | str) -> Column:
    """A dot is N, what isn't a letter goes, letters but ACGT are N."""
    letters = F.regexp_replace(F.replace(col(seq), F.lit("."), F.lit("N")), "[^A-Za-z]", "")
    return F.regexp_replace(F.upper(letters), "[^ACGT]", "N")


def normalise_reference(seq: Column | str, n_to_a: bool = False) -> Column:
    """Ambiguity codes and gaps are N (A with n_to_a); what is neither they nor a base goes and takes no offset."""
    kept = F.regexp_replace(F.upper(col(seq)), f"[^ACGT{AMBIGUOUS}]", "")
    return F.regexp_replace(kept, f"[{AMBIGUOUS}]", "A" if n_to_a else "N")


def bisulfite(seq: Column | str, strand: str = "+") -> Column:
    """C read as T on the forward strand, G as A on the other."""
    return F.translate(col(seq), *(("C", "T") if strand == "+" else ("G", "A")))


def prose_to_dna(text: Column | str) -> Column:
    """Letter number i (A = 0) as ACGT[i mod 4], X and Z as N; other characters go."""
    bases = "".join("N" if c in "XZ" else "ACGT"[i % 4] for i, c in enumerate(LETTERS))
    # most of what goes is ASCII, which goes in the same walk; the expression is for the rest
    others = "".join(c for c in map(chr, range(1, 128)) if not c.isalpha())
    known = F.translate(F.coalesce(col(text), F.lit("")), LETTERS + LETTERS.lower() + others, bases + bases)
    return F.regexp_replace(known, "[^ACGTN]+", "")


def trim(seq: Column | str, five: int, three: int) -> Column:
    """Without `five` characters in front, then without `three` at the end."""
    s = col(seq)
    return F.substring(s, F.lit(five + 1), F.greatest(F.length(s) - five - three, F.lit(0)))


def pack_2bit(seq: Column | str) -> Column:
    """Up to 31 bases as a LONG; null where a base isn't ACGT."""
    s = col(seq)
    return F.when(~s.rlike("[^ACGT]"), F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("long"))


def packed_mismatches(a: Column, b: Column) -> Column:
    """Bases in which two packed strings of one length differ."""
    x = a.bitwiseXOR(b)
    odd = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return F.bit_count(odd.bitwiseAND(F.lit(0x5555555555555555)))


def mismatches(read: Column, window: Column) -> Column:
    """Positions from 0 where two strings of one length differ, or the read has N."""
    at = F.sequence(F.lit(0), F.length(read) - 1)
    base = lambda s, i: F.substring(s, i + 1, F.lit(1))
    return F.when(F.length(read) > 0, F.filter(at, lambda i: (base(read, i) != base(window, i)) | (base(read, i) == "N"))).otherwise(F.array().cast("array<int>"))


def first_word(name: Column | str) -> Column:
    return F.regexp_extract(col(name), r"^\S*", 0)


def mate_name(name: Column | str, mate: Column | str) -> Column:
    """The name with /1 or /2 unless it has it."""
    n, m = col(name), F.concat(F.lit("/"), col(mate).cast("string"))
    return F.when((col(mate) == 0) | n.endswith(m), n).otherwise(F.concat(n, m))


def query_name(name: Column | str, mate: Column | str) -> Column:
    """Without the mate's suffix and what follows white space."""
    return first_word(F.when(col(mate) > 0, F.regexp_replace(col(name), "/[12]$", "")).otherwise(col(name)))


#: Bases of a packed word, two bits each, the first one highest.
WORD = 31


def _words(parts: Column, digits: str, fill: str) -> Column:
    """Strings of up to WORD of ACGTN as longs, by the digit of each letter; short ones are filled up."""
    return F.transform(parts, lambda p: _word(p, digits, fill))


def _word(part: Column, digits: str, fill: str) -> Column:
    return F.conv(F.rpad(F.translate(part, "ACGTN", digits), WORD, fill), 4, 10).cast("long")


def packed_words(seq: Column | str) -> tuple[Column, Column]:
    """A sequence of any length in two bits a base (N as A), and where it has N or has ended."""
    parts = F.regexp_extract_all(col(seq), F.lit(f".{{1,{WORD}}}"), F.lit(0))
    whole = lambda p: (F.length(p) == WORD) & ~F.contains(p, F.lit("N"))
    return _words(parts, "01230", "0"), F.transform(parts, lambda p: F.when(whole(p), F.lit(0).cast("long")).otherwise(_word(p, "00001", "1")))


def flag_words(flags: Column) -> Column:
    """A string of A (no) and C (yes) as words in which a yes is the lower bit of its base."""
    return _words(F.regexp_extract_all(flags, F.lit(f".{{1,{WORD}}}"), F.lit(0)), "01000", "0")


def word_at(words: Column, at: Column, missing: int) -> Column:
    """WORD bases from any position on, of packed words; `missing` stands for words behind the last."""
    shift = lambda how, x, by: F.call_function(how, x, (2 * by).cast("int"))
    i, s = F.floor(at / WORD).cast("int"), (at % WORD).cast("int")
    get = lambda k: F.coalesce(F.get(words, k), F.lit(missing).cast("long"))
    high = shift("shiftleft", get(i), s).bitwiseAND(F.lit((1 << 2 * WORD) - 1))
    return high.bitwiseOR(shift("shiftrightunsigned", get(i + 1), WORD - s))


def packed_compare(words: Column, ns: Column, at: Column, read: Column, read_n: Column, counted: Column, inside: Column, chunks: int) -> tuple[Column, Column]:
    """For a read of at most `chunks` words laid at a position: how many of the counted bases differ (a read's N always does), and whether the window has an N or isn't whole.

    read, read_n, counted and inside are the read's words: its bases, its Ns, what counts, and how far it goes.
    """
    n, broken = F.lit(0), F.lit(False)
    ones = int("01" * WORD, 2)
    for k in range(chunks):
        own = lambda c, k=k: F.coalesce(F.get(c, F.lit(k)), F.lit(0).cast("long"))
        x = word_at(words, at + WORD * k, 0).bitwiseXOR(own(read))
        wrong = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(own(read_n)).bitwiseAND(own(counted))
        n = n + F.bit_count(wrong)
        broken = broken | (word_at(ns, at + WORD * k, ones).bitwiseAND(own(inside)) != 0)
    return n, broken
