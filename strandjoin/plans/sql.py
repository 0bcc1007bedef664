"""DuckDB SQL over the same tables, put together from common table expressions."""

from __future__ import annotations

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "".join("N" if c in "XZ" else "ACGT"[i % 4] for i, c in enumerate(LETTERS))
DNA = f"translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}')"


def rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def changed(s: str, at: int) -> str:
    return f"(substr({s}, 1, {at}) || translate(substr({s}, {at + 1}, 1), 'ACGT', 'CGTA') || substr({s}, {at + 2}))"


QUAL = "array_to_string(list_transform(range(36), lambda i: chr((35 + (item_id * 7 + o + i * 3) % 39)::INT)), '')"
REFS = f"refs AS (SELECT doc_id AS ref_id, {DNA} AS seq FROM documents)"
ITEMS = f"items AS (SELECT item_id, {DNA} AS dna FROM benchmark), win AS (SELECT item_id, o, substr(dna, o::INT + 1, 36) AS base FROM (SELECT item_id, dna, unnest(range(0, len(dna) - 35, 18)) AS o FROM items))"
READS = f"""{ITEMS}, reads AS (SELECT item_id * 100000 + o AS read_id, 0 AS mate,
  CASE (o // 18) % 4 WHEN 0 THEN base WHEN 1 THEN {changed("base", 10)} WHEN 2 THEN {rc("base")} ELSE {rc(changed(changed("base", 3), 30))} END AS seq, {QUAL} AS qual FROM win)"""


def mates(orientation: str) -> str:
    t1, t2 = {"fr": (False, True), "rf": (True, False), "ff": (False, False)}[orientation]
    side = lambda m, shift, turned: f"SELECT item_id * 100000 + o - {shift} AS read_id, {m} AS mate, {rc('base') if turned else 'base'} AS seq, {QUAL} AS qual FROM win"
    return f"{ITEMS}, sides AS ({side(1, 0, t1)} UNION ALL {side(2, 54, t2)}), reads AS (SELECT * FROM sides WHERE read_id >= 0 AND read_id IN (SELECT read_id FROM sides GROUP BY 1 HAVING count(*) = 2))"


def varied_mates() -> str:
    """Mates whose inserts differ: the second lies 18 to 126 bases behind the first."""
    return f"{ITEMS}, sides AS (SELECT item_id * 100000 + o AS read_id, 1 AS mate, base AS seq, {QUAL} AS qual FROM win UNION ALL SELECT item_id * 100000 + o - 18 * s AS read_id, 2, {rc('base')}, {QUAL} FROM win, range(1, 8) AS g(s) WHERE (item_id * 100000 + o - 18 * s) // 18 % 7 + 1 = s), reads AS (SELECT * FROM sides WHERE read_id >= 0 AND read_id IN (SELECT read_id FROM sides GROUP BY 1 HAVING count(*) = 2))"


def turned_mates(orientation: str) -> str:
    """mates, every other pair as seen from the other strand: the mates are swapped, and where both lie on one strand reversed."""
    other = "seq" if orientation != "ff" else rc("seq")
    swap = "read_id // 18 % 2 = 1"
    text = mates(orientation)
    head, tail = text.rsplit(", reads AS (", 1)
    return f"{head}, straight AS ({tail}, reads AS (SELECT read_id, CASE WHEN {swap} THEN 3 - mate ELSE mate END AS mate, CASE WHEN {swap} THEN {other} ELSE seq END AS seq, qual FROM straight)"


def mixed() -> str:
    """Pairs of fr, of which every third has a second mate that isn't in the references, and single reads."""
    head, tail = mates("fr").rsplit(", reads AS (", 1)
    kinds = READS[len(ITEMS) :].replace(", reads AS (", ", alone AS (", 1)
    return f"{head}, straight AS ({tail}{kinds}, reads AS (SELECT read_id, mate, CASE WHEN mate = 2 AND read_id // 18 % 3 = 0 THEN repeat('ACGTTGCAA', 4) ELSE seq END AS seq, qual FROM straight UNION ALL SELECT read_id + 1, 0, seq, qual FROM alone)"


def hits(mode: str, budget: int, reads: str = READS, seed: int = 28, most: int = 70, forward: bool = True, reverse: bool = True, rounding: bool = True) -> str:
    """CTEs up to h (read_id, mate, fw, ref_id, off, seq, qual, w, stratum, penalty, mms) for reads of 36 bases."""
    n = 36 if mode == "v" else seed
    width = n // (budget + 1)
    strands = [f"SELECT read_id, mate, true AS fw, seq AS p, qual AS pq, 0 AS seed_at FROM reads"] * forward + [f"SELECT read_id, mate, false AS fw, {rc('seq')} AS p, reverse(qual) AS pq, {36 - n} AS seed_at FROM reads"] * reverse
    q = "ascii(substr(pq, i::INT + 1, 1)) - 33"
    cost = f"least(30, (({q} + 5) // 10) * 10)" if rounding else q
    five = "(CASE WHEN fw THEN i ELSE 35 - i END)"
    valid = f"stratum <= {budget}" + (f" AND penalty <= {most}" if mode == "n" else "")
    return f"""WITH {REFS}, {reads}, o AS ({" UNION ALL ".join(strands)}),
km AS (SELECT ref_id, pos, substr(seq, pos::INT + 1, {width}) AS kmer FROM (SELECT ref_id, seq, unnest(range(len(seq) - {width - 1})) AS pos FROM refs WHERE len(seq) >= {width})),
s AS (SELECT *, seed_at + blk * {width} AS at0 FROM (SELECT *, unnest(range({budget + 1})) AS blk FROM o)),
c AS (SELECT DISTINCT read_id, mate, fw, p, pq, ref_id, pos - at0 AS off FROM s JOIN km ON kmer = substr(p, at0::INT + 1, {width})),
x AS (SELECT c.*, substr(refs.seq, off::INT + 1, 36) AS w FROM c JOIN refs USING (ref_id) WHERE off >= 0 AND off + 36 <= len(refs.seq)),
y AS (SELECT *, list_filter(range(36), lambda i: substr(p, i::INT + 1, 1) <> substr(w, i::INT + 1, 1) OR substr(p, i::INT + 1, 1) = 'N') AS bad FROM x WHERE NOT contains(w, 'N')),
z AS (SELECT *, len(list_filter(bad, lambda i: {five} < {n})) AS stratum, coalesce(list_sum(list_transform(bad, lambda i: {cost})), 0)::BIGINT AS penalty FROM y),
h AS (SELECT read_id, mate, fw, ref_id, off::BIGINT AS off, p AS seq, pq AS qual, w, bad, stratum::BIGINT AS stratum, penalty,
  array_to_string(list_transform(list_sort(list_transform(bad, lambda i: {five})), lambda f: f::VARCHAR || ':' || substr(w, (CASE WHEN fw THEN f ELSE 35 - f END)::INT + 1, 1) || '>' || substr(p, (CASE WHEN fw THEN f ELSE 35 - f END)::INT + 1, 1)), ',') AS mms FROM z WHERE {valid})"""


ORDER = "stratum, penalty, ref_id, off, fw DESC"
STRAND = "CASE WHEN fw THEN '+' ELSE '-' END AS strand"
HIT_COLUMNS = f"read_id, {STRAND}, ref_id, off, stratum, penalty, mms"


def pairs(orientation: str, contain: bool = False, low: int = 0, high: int = 250, v: int = 1, make=mates) -> str:
    f1, f2 = {"fr": (True, False), "rf": (False, True), "ff": (True, True)}[orientation]
    le = "<=" if contain else "<"
    inside = "" if contain else " AND insert > 36"
    return f"""{hits("v", v, make(orientation))}, j AS (SELECT a.read_id, a.ref_id, a.off AS off1, b.off AS off2,
  CASE WHEN a.fw = {f1} AND b.fw = {f2} AND a.off {le} b.off THEN 1 WHEN b.fw <> {f2} AND a.fw <> {f1} AND b.off {le} a.off THEN 2 END AS first
  FROM h a JOIN h b ON a.read_id = b.read_id AND a.ref_id = b.ref_id AND a.mate = 1 AND b.mate = 2),
pr AS (SELECT *, CASE WHEN first = 1 THEN off2 + 36 - off1 ELSE off1 + 36 - off2 END AS insert FROM j WHERE first IS NOT NULL),
pairs AS (SELECT * FROM pr WHERE insert BETWEEN {low} AND {high}{inside})"""
