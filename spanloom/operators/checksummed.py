"""Substitutes that pass the check of the original's scheme: a check is a sum or a fold over places, and its inverse a table from remainders to check characters.

A scheme is data, not an expression: what each place may hold, and steps that fill in check characters. A step sums weighted characters (or
looks them up by place, or goes through the states of an automaton), takes the remainder and reads the check characters that close it. So a
drawn body gets its valid characters at once, without trying them, and a plan has the same size however many schemes there are.
Remainders that no character closes, and draws that give the original, are drawn again.

The characters are drawn from a keyed hash; none comes from the original's. Separators, case and length stay. A value that
passes no scheme's check, and null, give null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.checks import alnum, digits
from ..functions.drawing import draw, relaid

#: A character counts as its place in here, unless a step has a table for it.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Draws before a value is given up; one in five fails at most.
DRAWS = 24
TERM = "struct<p:int,w:int,t:array<int>>"
SCHEME = f"struct<name:string,category:string,letters:boolean,length:int,alpha:boolean,dash:int,fields:array<array<string>>,steps:array<struct<at:int,base:int,fold:boolean,terms:array<{TERM}>,out:array<string>>>>"

Field = list[str]


def free(n: int, chars: str = "0123456789") -> list[Field]:
    return [list(chars)] * n


def span(low: int, high: int, width: int = 2) -> list[Field]:
    return [[f"{x:0{width}d}" for x in range(low, high + 1)]]


def fixed(text: str) -> list[Field]:
    return [[text]]


YMD, DMY = span(40, 99) + span(1, 12) + span(1, 28), span(1, 28) + span(1, 12) + span(40, 99)
CENTURY = span(1940, 1999, 4)


def _terms(weights: Iterable, places: Iterable[int] | None) -> list[dict]:
    """A term for each place: a weight, a table of what each character of the alphabet counts, or None to write the character behind the number so far."""
    w = list(weights)
    at = list(places) if places is not None else list(range(len(w)))
    return [{"p": p, "w": None, "t": x} if isinstance(x, list) else {"p": p, "w": x, "t": None} for p, x in zip(at, w, strict=True)]


def step(at: int, base: int, weights: Iterable, out: Callable[[int], str] | Sequence[str], places: Iterable[int] | None = None) -> dict:
    """Check characters from a place on, as a function of the others' sum modulo base."""
    return {"at": at, "base": base, "fold": False, "terms": _terms(weights, places), "out": [out(r) for r in range(base)] if callable(out) else list(out)}


def folded(at: int, tables: Iterable[list[int]], places: Iterable[int], out: Sequence[str]) -> dict:
    """A check character as a function of the state after all places; a table gives the next state from ten times the state plus the digit."""
    return {"at": at, "base": len(out), "fold": True, "terms": _terms(tables, places), "out": list(out)}


def closing(base: int, weight: int = 1, more: str = "", target: int = 0) -> list[str]:
    """The digit (or further character) that brings a sum to the target: the inverse of its weight. Empty where there is none."""
    out = [""] * base
    for v, c in reversed(list(enumerate("0123456789" + more))):
        out[(target - weight * v) % base] = c
    return out


def plain(base: int) -> list[str]:
    """The remainder itself, where it is a digit."""
    return [str(r) if r < 10 else "" for r in range(base)]


def powers(n: int, base: int, times: int = 1, shift: int = 0) -> list[int]:
    """Weights that make a sum of digits the number they write."""
    return [times * pow(10, n - 1 - i + shift, base) % base for i in range(n)]


_DOUBLED = [2 * d - 9 * (d > 4) for d in range(10)] + [0] * 26


def luhn(at: int, start: int = 0, ahead: int = 0) -> dict:
    """Luhn's digit over the places from start to the one before; ahead is what a fixed prefix adds."""
    places = list(range(start, at))
    return step(at, 10, [_DOUBLED if (at - p) % 2 else 1 for p in places], closing(10, target=-ahead), places)


@cache
def _dihedral() -> tuple[list[int], list[list[int]]]:
    """The group of ten elements by its rule, and one digit permutation's powers."""
    times = [[((a + b) % 5 if b < 5 else (a + b) % 5 + 5) if a < 5 else ((a - b) % 5 + 5 if b < 5 else (a - b) % 5) for b in range(10)] for a in range(10)]
    once = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    turned = [list(range(10))]
    for _ in range(7):
        turned.append([once[x] for x in turned[-1]])
    return [x for row in times for x in row], turned


def verhoeff(at: int, n: int) -> dict:
    """Verhoeff's digit over the first n places, read from the right."""
    times, turned = _dihedral()
    tables = [[times[10 * s + turned[(i + 1) % 8][d]] for s in range(10) for d in range(10)] for i in range(n)]
    return folded(at, tables, range(n - 1, -1, -1), [str(next(c for c in range(10) if times[10 * c + r] == 0)) for r in range(10)])


def iso_11_10(at: int) -> dict:
    """The digit of ISO 7064 mod 11,10 over all places before. The state is the running product plus one, so that it begins with 0 for 10."""
    table = []
    for s in range(11):
        product = (s + 10) % 11
        table += [(((product + d + 9) % 10 + 1) * 2 % 11 + 1) % 11 for d in range(10)]
    return folded(at, [table] * at, range(at), [str((11 - (s + 10) % 11) % 10) for s in range(11)])


def _values(order: str, values: Iterable[int] | None = None) -> list[int]:
    """What each character of the alphabet counts: its place in an order, or a value of its own."""
    known = dict(zip(order, values if values is not None else range(len(order)), strict=True))
    return [known.get(c, 0) for c in ALPHABET]


def _times(table: list[int], w: int, base: int) -> list[int]:
    return [w * x % base for x in table]


def _digit_sums(w: int) -> list[int]:
    return [w * d // 10 + w * d % 10 for d in range(10)] + [0] * 26


def _weights(n: int) -> range:
    """n + 1 down to 2."""
    return range(n + 1, 1, -1)


def _schemes() -> list[dict]:
    out = []

    def add(name: str, category: str, fields: list[Field], *steps: dict, letters: bool = False, dash: int = 0) -> None:
        length = sum(len(f[0]) for f in fields)
        out.append({"name": name, "category": category, "letters": letters, "length": length, "alpha": fields[0][0][0].isalpha(), "dash": dash, "fields": fields, "steps": list(steps)})

    person, company, account = "national_id", "company_id", "iban"
    c, cc = fixed("0"), fixed("00")
    two97 = lambda r: f"{97 - r:02d}"
    eleven = lambda **wraps: [str(wraps.get(f"r{11 - r}", 11 - r)) for r in range(11)]

    add("imei", person, free(14) + c, luhn(14))
    vin = "ABCDEFGHJKLMNPRSTUVWXYZ"
    drawn = "0123456789" + vin
    worth = _values(drawn, [*range(10), *(int(x) for x in "12345678123457923456789")])
    for first in ("0123456789", vin):
        places = [i for i in range(17) if i != 8]
        weights = [8, 7, 6, 5, 4, 3, 2, 10, 9, 8, 7, 6, 5, 4, 3, 2]
        add("vin", person, free(1, first) + free(7, drawn) + c + free(8, drawn), step(8, 11, [_times(worth, w, 11) for w in weights], "0123456789X", places), letters=True)
    for n in (19, 20):
        add("iccid", person, fixed("89") + free(n - 3) + c, luhn(n - 1))
    add("npi", person, free(1, "12") + free(8) + c, luhn(9, ahead=24))
    add("dea", person, free(1, "ABFM") + free(1, ALPHABET[10:]) + free(6) + c, step(8, 10, [1, 2, 1, 2, 1, 2], plain(10), range(2, 8)), letters=True)
    add("nir", person, free(1, "12") + span(40, 99) + span(1, 12) + span(1, 95) + free(6) + cc, step(13, 97, powers(13, 97), two97), letters=True)
    add("nhs", person, free(1, "4567") + free(8) + c, step(9, 11, _weights(9), closing(11)))
    add("steuer_id", person, free(1, "123456789") + free(9) + c, iso_11_10(10))
    letter = [sum(_digit_sums(w)[d] for w, d in ((2, n // 10), (1, n % 10))) for n in range(1, 27)]
    pension = [*map(_digit_sums, (2, 1, 2, 5, 7, 1, 2, 1)), _values(ALPHABET[10:], letter), *map(_digit_sums, (2, 1))]
    add("de_rvnr", person, span(10, 89) + DMY + free(1, ALPHABET[10:]) + free(2) + c, step(11, 10, pension, plain(10)), letters=True)
    add("at_svnr", person, free(1, "123456789") + free(2) + c + DMY, step(3, 11, [3, 7, 9, 5, 8, 4, 2, 1, 6], plain(11), [0, 1, 2, 4, 5, 6, 7, 8, 9]))
    spanish = "TRWAGMYFPDXBNJZSQVHLCKE"
    add("dni", person, free(8) + c, step(8, 23, powers(8, 23), spanish), letters=True)
    add("dni", person, free(1, "XYZ") + free(7) + c, step(8, 23, [_times(_values("XYZ"), pow(10, 7, 23), 23), *powers(8, 23)[1:]], spanish), letters=True)
    # Of A to Z (and 0 to 9) at odd places.
    odd = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
    odd_worth, even_worth = _values(ALPHABET, [*odd[:10], *odd]), _values(ALPHABET, [*range(10), *range(26)])
    code = free(6, ALPHABET[10:]) + span(40, 99) + free(1, "ABCDEHLMPRST") + span(1, 31) + free(1, "ABCDEFGHIL") + free(3) + c
    add("it_codice_fiscale", person, code, step(15, 26, [odd_worth if i % 2 == 0 else even_worth for i in range(15)], ALPHABET[10:]), letters=True)
    add("pt_nif", person, free(1, "123") + free(7) + c, step(8, 11, _weights(8), lambda r: "0" if r < 2 else str(11 - r)))
    add("bsn", person, free(1, "123456789") + free(7) + c, step(8, 11, _weights(8), closing(11, -1)))
    add("be_nrn", person, YMD + free(3) + cc, step(9, 97, powers(9, 97), two97))
    add("pesel", person, YMD + free(4) + c, step(10, 10, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3], closing(10)))
    add("se_personnummer", person, YMD + free(3) + c, luhn(9))
    add("se_personnummer", person, CENTURY + span(1, 12) + span(1, 28) + free(3) + c, luhn(11, start=2))
    add("no_fnr", person, DMY + free(3) + cc, step(9, 11, [3, 7, 6, 1, 8, 9, 4, 5, 2], closing(11)), step(10, 11, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2], closing(11)))
    finnish = "0123456789ABCDEFHJKLMNPRSTUVWXY"
    add("fi_hetu", person, DMY + span(2, 899, 3) + c, step(9, 31, powers(9, 31), finnish), letters=True, dash=7)
    add("fi_hetu", person, DMY + fixed("A") + span(2, 899, 3) + c, step(10, 31, powers(9, 31), finnish, [0, 1, 2, 3, 4, 5, 7, 8, 9]), letters=True)
    add("ch_ahv", person, fixed("756") + free(9) + c, step(12, 10, [1, 3] * 6, closing(10)))
    add("ro_cnp", person, free(1, "12") + YMD + span(1, 46) + free(3) + c, step(12, 11, [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9], lambda r: "1" if r == 10 else str(r)))
    add("bg_egn", person, YMD + free(3) + c, step(9, 11, [2, 4, 8, 5, 10, 9, 7, 3, 6], lambda r: str(r % 10)))
    add("is_kennitala", person, DMY + free(2) + c + fixed("9"), step(8, 11, [3, 2, 7, 6, 5, 4, 3, 2], closing(11)))
    add("ee_isikukood", person, free(1, "34") + YMD + free(3) + c, step(10, 11, [1, 2, 3, 4, 5, 6, 7, 8, 9, 1], plain(11)))
    add("hr_oib", person, free(10) + c, iso_11_10(10))
    add("rs_jmbg", person, span(1, 28) + span(1, 12) + span(940, 999, 3) + free(5) + c, step(12, 11, [7, 6, 5, 4, 3, 2] * 2, closing(11)))
    add("cz_rc", person, YMD + free(3) + c, step(9, 11, powers(9, 11, shift=1), closing(11)))
    add("gr_amka", person, DMY + free(4) + c, luhn(10))
    add("lu_matricule", person, CENTURY + span(1, 12) + span(1, 28) + free(3) + cc, luhn(11), verhoeff(12, 11))
    add("ie_pps", person, free(7) + c, step(7, 23, range(8, 1, -1), "WABCDEFGHIJKLMNOPQRSTUV"), letters=True)
    add("tr_tckn", person, free(1, "123456789") + free(8) + cc, step(9, 10, [7, -1] * 4 + [7], plain(10)), step(10, 10, [1] * 10, plain(10)))
    ten = lambda r: str(r * 10 % 11 % 10)
    add("cpf", person, free(9) + cc, step(9, 11, _weights(9), ten), step(10, 11, _weights(10), ten))
    add("br_pis", person, free(10) + c, step(10, 11, [3, 2, 9, 8, 7, 6, 5, 4, 3, 2], ["0" if x == "" else x for x in closing(11)]))
    for n in (7, 8):
        add("rut", person, free(1, "123456789") + free(n - 1) + c, step(n, 11, [3, 2, 7, 6, 5, 4, 3, 2][8 - n :], eleven(r11="0", r10="K")), letters=True)
    curp = _values("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", [*range(24), *range(25, 37)])
    name = free(4, "ABCDEFGHJKLMNPRSTUVWXYZ") + YMD + free(1, "HM") + free(5, "BCDFGHJKLMNPRSTVWXYZ") + free(1) + c
    add("mx_curp", person, name, step(17, 10, [_times(curp, 18 - i, 10) for i in range(17)], closing(10)), letters=True)
    add("ec_cedula", person, span(1, 24) + free(1, "012345") + free(6) + c, luhn(9))
    add("uy_ci", person, free(1, "123456") + free(6) + c, step(7, 10, [2, 9, 8, 7, 6, 3, 4], closing(10)))
    add("aadhaar", person, free(1, "23456789") + free(10) + c, verhoeff(11, 11))
    add("resident_cn", person, free(1, "123456") + free(5) + CENTURY + span(1, 12) + span(1, 28) + free(3) + c, step(17, 11, [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2], "10X98765432"), letters=True)
    hong_kong = _values(ALPHABET[10:], [10 + i for i in range(26)])
    # A missing first letter counts 36, nine times.
    add("hk_id", person, free(1, ALPHABET[10:]) + free(6) + c, step(7, 11, [_times(hong_kong, 8, 11), 7, 6, 5, 4, 3, 2], closing(11, more="A", target=-36 * 9)), letters=True)
    add("jp_my_number", person, free(11) + c, step(11, 11, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2], lambda r: "0" if r < 2 else str(11 - r)))
    add("kr_rrn", person, YMD + free(1, "12") + free(5) + c, step(12, 11, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], lambda r: str((11 - r) % 10)))
    add("th_id", person, free(1, "12345678") + free(11) + c, step(12, 11, _weights(12), lambda r: str((11 - r) % 10)))
    add("nric", person, free(1, "ST") + free(7) + c, step(8, 11, [_values("ST", [0, 4]), 2, 7, 6, 5, 4, 3, 2], "JZIHGFEDCBA"), letters=True)
    add("tfn", person, free(1, "123456789") + free(7) + c, step(8, 11, [1, 4, 3, 7, 5, 8, 6, 9], closing(11, 10)))
    add("au_medicare", person, free(1, "23456") + free(7) + c + free(1, "123456789"), step(8, 10, [1, 3, 7, 9, 1, 3, 7, 9], plain(10)))
    add("nz_ird", person, span(10, 99) + free(5) + c, step(7, 11, [2, 7, 6, 5, 4, 3, 2], closing(11)))
    add("nz_ird", person, span(10, 14) + free(6) + c, step(8, 11, [3, 2, 7, 6, 5, 4, 3, 2], closing(11)))
    add("sin", person, free(1, "12345679") + free(7) + c, luhn(8))
    add("za_id", person, YMD + free(4) + free(1, "01") + free(1, "8") + c, luhn(12))
    add("il_id", person, free(1, "123456789") + free(7) + c, luhn(8))
    add("lei", company, free(4) + fixed("00") + free(12, ALPHABET) + cc, step(18, 97, [None] * 18, lambda r: f"{98 - r * 100 % 97:02d}"), letters=True)
    add("siret", company, free(1, "3456789") + free(7) + c + free(4) + c, luhn(8), luhn(13))
    add("fr_vat", company, cc + free(1, "3456789") + free(7) + c, luhn(10, start=2), step(0, 97, powers(9, 97, 3), lambda r: f"{(12 + r) % 97:02d}", range(2, 11)))
    add("be_vat", company, free(1, "1") + free(7) + cc, step(8, 97, powers(8, 97), two97))
    add("it_vat", company, free(1, "123456789") + free(9) + c, luhn(10))
    add("se_vat", company, free(1, "56789") + free(8) + c + fixed("01"), luhn(9))
    add("dk_cvr", company, free(1, "123456789") + free(6) + c, step(7, 11, [2, 7, 6, 5, 4, 3, 2], closing(11)))
    add("pl_nip", company, free(1, "123456789") + free(8) + c, step(9, 11, [6, 5, 7, 2, 3, 4, 5, 6, 7], plain(11)))
    add("siren", company, free(1, "3456789") + free(7) + c, luhn(8))
    add("pl_regon", company, free(1, "123456789") + free(7) + c, step(8, 11, [8, 9, 2, 3, 4, 5, 6, 7], lambda r: str(r % 10)))
    add("no_orgnr", company, free(1, "89") + free(7) + c, step(8, 11, [3, 2, 7, 6, 5, 4, 3, 2], closing(11)))
    add("fi_ytunnus", company, free(1, "123") + free(6) + c, step(7, 11, [7, 9, 10, 5, 8, 4, 2], closing(11)))
    chinese = "0123456789ABCDEFGHJKLMNPQRTUWXY"
    credit = free(1, "159") + free(1, "123") + free(6) + free(9, chinese) + c
    add("cn_uscc", company, credit, step(17, 31, [_times(_values(chinese), pow(3, i, 31), 31) for i in range(17)], lambda r: chinese[-r % 31]), letters=True)
    two = lambda r: "0" if r < 2 else str(11 - r)
    add("cnpj", company, free(8) + fixed("0001") + cc, step(12, 11, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], two), step(13, 11, [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], two))
    add("cuit", company, [["20", "23", "24", "27", "30", "33", "34"]] + free(8) + c, step(10, 11, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2], eleven(r11=0, r10=9)))
    add("co_nit", company, free(1, "89") + free(8) + c, step(9, 11, [41, 37, 29, 23, 19, 17, 13, 7, 3], lambda r: str(r if r < 2 else 11 - r)))
    add("pe_ruc", company, [["10", "20"]] + free(8) + c, step(10, 11, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2], lambda r: str((11 - r) % 10)))
    add("abn", company, cc + free(9), step(0, 89, range(3, 20, 2), lambda r: str(10 + -r % 89), range(2, 11)))
    add("au_acn", company, free(8) + c, step(8, 10, range(8, 0, -1), closing(10)))
    bank = powers(5, 97, 89) + powers(5, 97, 15) + [_times(_values(ALPHABET, [*range(10), *range(1, 10), *range(1, 10), *range(2, 10)]), w, 97) for w in powers(11, 97, 3)]
    add("rib", account, free(21) + cc, step(21, 97, bank, two97), letters=True)
    add("mx_clabe", account, free(17) + c, step(17, 10, [[d * (3, 7, 1)[i % 3] % 10 for d in range(10)] + [0] * 26 for i in range(17)], closing(10)))
    add("aba", account, span(1, 12) + free(6) + c, step(8, 10, [3, 7, 1] * 2 + [3, 7], closing(10)))
    add("ean13", "number", free(12) + c, step(12, 10, [1, 3] * 6, closing(10)))
    add("isbn10", "number", free(9) + c, step(9, 11, _weights(9), closing(11, more="X")), letters=True)
    return out


#: All schemes; a name has one for each length.
SCHEMES = _schemes()
NAMES = list(dict.fromkeys(s["name"] for s in SCHEMES))
CATEGORIES = list(dict.fromkeys(s["category"] for s in SCHEMES))


def _table() -> Column:
    """All schemes as one constant."""
    return F.from_json(F.lit(json.dumps(SCHEMES)), f"array<{SCHEME}>")


def _bare(v: Column, scheme: Column) -> Column:
    return F.when(scheme["letters"], alnum(v)).otherwise(digits(v))


def solved(body: Column, scheme: Column) -> Column:
    """A body with all its check characters, whatever stands in their places. Null where a remainder has none."""

    def filled(v: Column, s: Column) -> Column:
        def add(r: Column, t: Column) -> Column:
            x = F.instr(F.lit(ALPHABET), F.substring(v, t["p"] + 1, F.lit(1))) - 1
            return F.when(s["fold"], F.get(t["t"], r * 10 + x)).when(t["t"].isNotNull(), r + F.get(t["t"], x)).when(t["w"].isNotNull(), r + t["w"] * x).otherwise((r * F.when(x < 10, 10).otherwise(100) + x) % s["base"])

        check = F.get(s["out"], F.pmod(F.aggregate(s["terms"], F.lit(0), add), s["base"]))
        return F.when(check != "", F.overlay(v, check, s["at"] + 1))

    return F.aggregate(scheme["steps"], body, filled)


def fitting(v: Column, schemes: Column) -> Column:
    """Those of the schemes whose length and check a value has."""
    both = F.struct(digits(v).alias("digits"), alnum(v).alias("alnum"))

    def fits(s: Column, bare: Column) -> Column:
        shape = (F.length(bare) == s["length"]) & (bare.rlike("^[A-Z]") == s["alpha"])
        return F.when(shape, F.coalesce(solved(bare, s) == bare, F.lit(False))).otherwise(False)

    return let(both, lambda b: F.filter(schemes, lambda s: fits(s, F.when(s["letters"], b["alnum"]).otherwise(b["digits"]))))


def _again(seed: Column, i: Column) -> Column:
    one = lambda mark: F.sha2(F.concat_ws("/", seed, F.lit(mark), i.cast("string")), 256)
    return F.concat(one("1"), one("2"))


def drawn(seed: Column, scheme: Column, old: Column) -> Column:
    """A value of the scheme, without separators, other than old, from a seed: the first of all draws that can be closed."""

    def draw_one(i: Column) -> Column:
        body = let(_again(seed, i), lambda s: F.array_join(F.transform(scheme["fields"], lambda f, k: F.get(f, draw(s, k, F.size(f)))), ""))
        return F.nullif(solved(body, scheme), old)

    return F.aggregate(F.sequence(F.lit(0), F.lit(DRAWS - 1)), F.lit(None).cast("string"), lambda got, i: F.when(got.isNotNull(), got).otherwise(draw_one(i)))


def _other(v: Column, seed: Column, scheme: Column) -> Column:
    new = let(_bare(v, scheme), lambda o: let(seed, lambda s: drawn(s, scheme, o)))
    return let(new, lambda n: F.when(scheme["letters"], relaid(v, n)).otherwise(relaid(v, n, "[0-9]")))


def substitute(v: Column, seed: Column, category: Column | None = None, name: Column | None = None) -> Column:
    """Another value that passes the check of the first scheme (of a category, of a name, or of all) which the value passes; null if there is none."""
    known = _table()
    if category is not None:
        known = F.filter(known, lambda s: s["category"] == category)
    if name is not None:
        known = F.filter(known, lambda s: s["name"] == name)
    return let(F.get(fitting(v, known), F.lit(0)), lambda s: F.when(s.isNotNull(), _other(v, seed, s)))


def specimen(seed: Column, number: Column) -> Column:
    """A value of the scheme of a number (its place among all), with the hyphen that belongs to it if there is one."""
    made = lambda s: drawn(seed, s, F.lit(None).cast("string"))
    dashed = lambda s: F.when(s["dash"] > 0, F.overlay(made(s), F.lit("-"), s["dash"], F.lit(0))).otherwise(made(s))
    return let(F.get(_table(), number), dashed)
