"""Checksums and shapes of identifiers, as Column expressions over the matched text.

Each function takes a string Column and returns a boolean one. They stay in the
JVM and are null-safe: a null gives null, anything else true or false.
Algorithms are the public ones of the schemes' owners.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def alnum(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, "[^0-9A-Za-z]", ""))


def _at(v: Column, i: int) -> Column:
    """The digit at a place from 0."""
    return F.substring(v, i + 1, 1).cast("int")


def dot(v: Column, weights: Sequence[int], start: int = 0) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _at(v, start + i) * w
    return total


def mod_of(v: Column, base: int) -> Column:
    """The remainder of a decimal string of any length."""
    return F.aggregate(F.filter(F.split(v, ""), lambda x: x != ""), F.lit(0), lambda r, x: (r * 10 + x.cast("int")) % base)


def _as_numbers(v: Column) -> Column:
    """Letters as 10 to 35."""
    letters = F.filter(F.split(v, ""), lambda x: x != "")
    return F.array_join(F.transform(letters, lambda x: F.when(x.rlike("[0-9]"), x).otherwise((F.ascii(x) - 55).cast("string"))), "")


def luhn(v: Column) -> Column:
    return F.call_function("luhn_check", digits(v))


def card(v: Column) -> Column:
    d = digits(v)
    return F.length(d).between(13, 19) & luhn(d) & ~d.rlike("^0+$")


def iban(v: Column) -> Column:
    x = alnum(v)
    turned = F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))
    return x.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (mod_of(_as_numbers(turned), 97) == 1)


def lei(v: Column) -> Column:
    x = alnum(v)
    return x.rlike("^[A-Z0-9]{18}[0-9]{2}$") & (mod_of(_as_numbers(x), 97) == 1)


def isin(v: Column) -> Column:
    x = alnum(v)
    return x.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & F.call_function("luhn_check", _as_numbers(x))


def ipv4(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda x: (F.length(x) <= 3) & (x.cast("int") <= 255)) & (F.size(F.split(v, r"\.")) == 4)


def siren(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 9) & luhn(d) & ~d.rlike("^0+$")


def siret(v: Column) -> Column:
    """Both the number and the company's number within it close a Luhn sum."""
    d = digits(v)
    return (F.length(d) == 14) & luhn(d) & siren(F.substring(d, 1, 9))


def ssn(v: Column) -> Column:
    d = digits(v)
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def nir(v: Column) -> Column:
    """French social security number: 97 less the remainder of its 13 digits, Corsica's letters as 19 and 18."""
    x = alnum(v)
    n = F.regexp_replace(F.regexp_replace(F.substring(x, 1, 13), "2A", "19"), "2B", "18")
    return x.rlike("^[1278][0-9]{4}(?:[0-9]{2}|2A|2B)[0-9]{8}$") & (F.lit(97) - mod_of(n, 97) == F.substring(x, 14, 2).cast("int"))


def aba(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 9) & (dot(d, [3, 7, 1] * 3) % 10 == 0) & ~d.rlike("^0+$")


def nhs(v: Column) -> Column:
    d = digits(v)
    rest = 11 - dot(d, range(10, 1, -1)) % 11
    return (F.length(d) == 10) & (F.when(rest == 11, 0).otherwise(rest) == _at(d, 9))


def dni(v: Column) -> Column:
    """Spanish DNI and NIE: a letter from the number modulo 23."""
    x = alnum(v)
    n = F.translate(F.substring(x, 1, 8), "XYZ", "012").cast("int")
    return x.rlike("^[XYZ0-9][0-9]{7}[A-Z]$") & (F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), n % 23 + 1, 1) == F.substring(x, 9, 1))


def bsn(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 9) & (dot(d, [9, 8, 7, 6, 5, 4, 3, 2, -1]) % 11 == 0) & ~d.rlike("^0+$")


def pesel(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 11) & ((10 - dot(d, [1, 3, 7, 9] * 2 + [1, 3]) % 10) % 10 == _at(d, 10))


def _iso_11_10(d: Column) -> Column:
    """The check digit of ISO 7064 mod 11,10 of the first ten digits."""
    ten = F.slice(F.filter(F.split(d, ""), lambda x: x != ""), 1, 10)

    def step(state: Column, x: Column) -> Column:
        total = (state + x.cast("int") + 9) % 10 + 1
        return total * 2 % 11

    return (11 - F.aggregate(ten, F.lit(10), step)) % 10


def steuer_id(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 11) & ~d.startswith("0") & (_iso_11_10(d) == _at(d, 10))


def pt_nif(v: Column) -> Column:
    d = digits(v)
    rest = dot(d, range(9, 1, -1)) % 11
    return (F.length(d) == 9) & (F.when(rest < 2, 0).otherwise(11 - rest) == _at(d, 8))


def be_nrn(v: Column) -> Column:
    d = digits(v)
    check = F.substring(d, 10, 2).cast("int")
    return (F.length(d) == 11) & ((97 - mod_of(F.substring(d, 1, 9), 97) == check) | (97 - mod_of(F.concat(F.lit("2"), F.substring(d, 1, 9)), 97) == check))


def se_personnummer(v: Column) -> Column:
    d = digits(v)
    return F.length(d).isin(10, 12) & luhn(F.substring(d, -10, 10))


def no_fnr(v: Column) -> Column:
    d = digits(v)
    one = (11 - dot(d, [3, 7, 6, 1, 8, 9, 4, 5, 2]) % 11) % 11
    two = (11 - dot(d, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11) % 11
    return (F.length(d) == 11) & (one == _at(d, 9)) & (two == _at(d, 10))


def fi_hetu(v: Column) -> Column:
    x = F.upper(v)
    n = F.concat(F.substring(x, 1, 6), F.substring(x, 8, 3)).cast("long")
    return x.rlike("^[0-9]{6}[-+A-FU-Y][0-9]{3}[0-9A-Z]$") & (F.substring(F.lit("0123456789ABCDEFHJKLMNPRSTUVWXY"), (n % 31 + 1).cast("int"), 1) == F.substring(x, 11, 1))


def ch_ahv(v: Column) -> Column:
    d = digits(v)
    return d.startswith("756") & ean13(d)


def ean13(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 13) & ((10 - dot(d, [1, 3] * 6) % 10) % 10 == _at(d, 12))


def it_codice_fiscale(v: Column) -> Column:
    """Odd places by the public table, even ones by value, modulo 26."""
    x = alnum(v)
    # Of A to Z (and 0 to 9) at odd places.
    table = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
    values = F.array(*[F.lit(n) for n in table])

    def value(i: int) -> Column:
        c = F.substring(x, i + 1, 1)
        return F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 65)

    total = F.lit(0)
    for i in range(15):
        total = total + (F.element_at(values, value(i) + 1) if i % 2 == 0 else value(i))
    return x.rlike("^[A-Z]{6}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]$") & (total % 26 == F.ascii(F.substring(x, 16, 1)) - 65)


def ro_cnp(v: Column) -> Column:
    d = digits(v)
    rest = dot(d, [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9]) % 11
    return (F.length(d) == 13) & ~d.startswith("0") & (F.when(rest == 10, 1).otherwise(rest) == _at(d, 12))


def bg_egn(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 10) & (dot(d, [2, 4, 8, 5, 10, 9, 7, 3, 6]) % 11 % 10 == _at(d, 9))


def tr_tckn(v: Column) -> Column:
    d = digits(v)
    odd, even = dot(d, [1, 0, 1, 0, 1, 0, 1, 0, 1]), dot(d, [0, 1, 0, 1, 0, 1, 0, 1])
    return (F.length(d) == 11) & ~d.startswith("0") & (F.pmod(odd * 7 - even, F.lit(10)) == _at(d, 9)) & (dot(d, [1] * 10) % 10 == _at(d, 10))


def cpf(v: Column) -> Column:
    d = digits(v)
    one = dot(d, range(10, 1, -1)) * 10 % 11 % 10
    two = dot(d, range(11, 1, -1)) * 10 % 11 % 10
    return (F.length(d) == 11) & ~d.rlike(r"^(\d)\1{10}$") & (one == _at(d, 9)) & (two == _at(d, 10))


def cnpj(v: Column) -> Column:
    d = digits(v)
    one, two = (dot(d, w) % 11 for w in ([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]))
    check = lambda r: F.when(r < 2, 0).otherwise(11 - r)
    return (F.length(d) == 14) & ~d.rlike(r"^(\d)\1{13}$") & (check(one) == _at(d, 12)) & (check(two) == _at(d, 13))


def cuit(v: Column) -> Column:
    d = digits(v)
    rest = 11 - dot(d, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return (F.length(d) == 11) & (F.when(rest == 11, 0).when(rest == 10, 9).otherwise(rest) == _at(d, 10))


def rut(v: Column) -> Column:
    x = F.regexp_replace(F.upper(v), "[^0-9K]", "")
    body = F.lpad(F.substring(x, F.lit(1), F.length(x) - 1), 8, "0")
    rest = 11 - dot(body, [3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return x.rlike("^[0-9]{7,8}[0-9K]$") & (F.when(rest == 11, "0").when(rest == 10, "K").otherwise(rest.cast("string")) == F.substring(x, -1, 1))


def resident_cn(v: Column) -> Column:
    x = alnum(v)
    rest = dot(x, [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]) % 11
    return x.rlike("^[1-9][0-9]{16}[0-9X]$") & (F.substring(F.lit("10X98765432"), rest + 1, 1) == F.substring(x, 18, 1))


def abn(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 11) & ((dot(d, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) - 10) % 89 == 0)


def tfn(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 9) & (dot(d, [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0)


def nric(v: Column) -> Column:
    """Singapore: weights 2 7 6 5 4 3 2, 4 more for T and G."""
    x = alnum(v)
    total = dot(x, [2, 7, 6, 5, 4, 3, 2], 1) + F.when(F.substring(x, 1, 1).isin("T", "G"), 4).otherwise(0)
    letters = F.when(F.substring(x, 1, 1).isin("S", "T"), "JZIHGFEDCBA").otherwise("XWUTRQPNMLK")
    return x.rlike("^[STFG][0-9]{7}[A-Z]$") & (F.substring(letters, total % 11 + 1, 1) == F.substring(x, 9, 1))


def za_id(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 13) & luhn(d) & F.substring(d, 3, 2).between("01", "12")


def il_id(v: Column) -> Column:
    d = F.lpad(digits(v), 9, "0")
    return (F.length(d) == 9) & luhn(d) & ~d.rlike("^0+$")


def sin(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 9) & luhn(d) & ~d.rlike("^[08]")


def _verhoeff(d: Column, n: int) -> Column:
    """Whether n digits, the last of them the check digit, close Verhoeff's scheme: the dihedral group of ten elements from its rule."""
    back = F.reverse(d)
    times = [[((a + b) % 5 if b < 5 else (a + b) % 5 + 5) if a < 5 else ((a - b) % 5 + 5 if b < 5 else (a - b) % 5) for b in range(10)] for a in range(10)]
    once = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rounds = [list(range(10))]
    for _ in range(7):
        rounds.append([once[x] for x in rounds[-1]])
    flat, turned = (F.array(*[F.lit(x) for row in t for x in row]) for t in (times, rounds))
    state = F.lit(0)
    for i in range(n):
        state = F.element_at(flat, state * 10 + F.element_at(turned, _at(back, i) + 10 * (i % 8) + 1) + 1)
    return state == 0


def aadhaar(v: Column) -> Column:
    """Twelve digits that begin with 2 to 9, by Verhoeff's scheme."""
    d = digits(v)
    return d.rlike("^[2-9][0-9]{11}$") & _verhoeff(d, 12)


def imei(v: Column) -> Column:
    return (F.length(digits(v)) == 15) & luhn(v)


def vin(v: Column) -> Column:
    x = alnum(v)
    plain = F.translate(x, "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
    rest = dot(plain, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return x.rlike("^[A-HJ-NPR-Z0-9]{17}$") & (F.when(rest == 10, "X").otherwise(rest.cast("string")) == F.substring(x, 9, 1))


def lat_long(v: Column) -> Column:
    pair = F.split(v, r"\s*,\s*")
    return (F.abs(pair[0].cast("double")) <= 90) & (F.abs(pair[1].cast("double")) <= 180)


def _least_digit(total: Column, base: int, wraps: dict[int, int]) -> Column:
    """What is missing to a multiple of base; wraps says what a remainder that is no digit stands for."""
    missing = (base - total % base) % base
    out = missing
    for k, x in wraps.items():
        out = F.when(missing == k, x).otherwise(out)
    return out


def _ends(v: Column, n: int, weights: Sequence[int], base: int, wraps: dict[int, int] | None = None) -> Column:
    """n digits of which the last is what the weighted others lack to a multiple of base."""
    d = digits(v)
    return (F.length(d) == n) & ~d.rlike("^0+$") & (_least_digit(dot(d, weights), base, wraps or {}) == _at(d, n - 1))


def th_id(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 13) & ((11 - dot(d, range(13, 1, -1)) % 11) % 10 == _at(d, 12))


def mx_clabe(v: Column) -> Column:
    d = digits(v)
    total = F.lit(0)
    for i in range(17):
        total = total + _at(d, i) * (3, 7, 1)[i % 3] % 10
    return (F.length(d) == 18) & ((10 - total % 10) % 10 == _at(d, 17))


def pl_nip(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 10) & (dot(d, [6, 5, 7, 2, 3, 4, 5, 6, 7]) % 11 == _at(d, 9)) & ~d.rlike("^0+$")


def pl_regon(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 9) & (dot(d, [8, 9, 2, 3, 4, 5, 6, 7]) % 11 % 10 == _at(d, 8)) & ~d.rlike("^0+$")


def dk_cvr(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 8) & (dot(d, [2, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0) & ~d.startswith("0")


def no_orgnr(v: Column) -> Column:
    return _ends(v, 9, [3, 2, 7, 6, 5, 4, 3, 2], 11)


def fi_ytunnus(v: Column) -> Column:
    return _ends(v, 8, [7, 9, 10, 5, 8, 4, 2], 11)


def is_kennitala(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 10) & (_least_digit(dot(d, [3, 2, 7, 6, 5, 4, 3, 2]), 11, {}) == _at(d, 8)) & _at(d, 9).isin(0, 8, 9)


def ee_isikukood(v: Column) -> Column:
    """Estonia and Lithuania: a second row of weights where the first one leaves 10."""
    d = digits(v)
    first, second = dot(d, [1, 2, 3, 4, 5, 6, 7, 8, 9, 1]) % 11, dot(d, [3, 4, 5, 6, 7, 8, 9, 1, 2, 3]) % 11
    return d.rlike("^[1-6][0-9]{10}$") & (F.when(first < 10, first).when(second < 10, second).otherwise(0) == _at(d, 10))


def hr_oib(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 11) & (_iso_11_10(d) == _at(d, 10))


def rs_jmbg(v: Column) -> Column:
    """The personal numbers of former Yugoslavia: a day of birth, then weights 7 to 2 twice."""
    return _ends(v, 13, [7, 6, 5, 4, 3, 2] * 2, 11) & digits(v).rlike("^(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])")


def cz_rc(v: Column) -> Column:
    """Czech and Slovak birth numbers of ten digits; a woman's month is 50 more."""
    d = digits(v)
    return d.rlike("^[0-9]{2}(?:[05][1-9]|[16][0-2]|[27][1-9]|[38][0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{4}$") & (d.cast("long") % 11 == 0)


def at_svnr(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 10) & ~d.startswith("0") & (dot(d, [3, 7, 9, 0, 5, 8, 4, 2, 1, 6]) % 11 == _at(d, 3))


def de_rvnr(v: Column) -> Column:
    """German pension insurance: the letter as two digits, the digits of all products summed."""
    x = alnum(v)
    d = F.concat(F.substring(x, 1, 8), F.lpad((F.ascii(F.substring(x, 9, 1)) - 64).cast("string"), 2, "0"), F.substring(x, 10, 2))
    total = F.lit(0)
    for i, w in enumerate([2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1]):
        product = _at(d, i) * w
        total = total + F.floor(product / 10) + product % 10
    return x.rlike("^[0-9]{8}[A-Z][0-9]{3}$") & (total % 10 == F.substring(x, 12, 1).cast("int"))


def gr_amka(v: Column) -> Column:
    d = digits(v)
    return d.rlike("^(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])[0-9]{7}$") & luhn(d)


def lu_matricule(v: Column) -> Column:
    """The twelfth digit closes a Luhn sum over the eleven before it, the thirteenth Verhoeff's scheme over the same eleven."""
    d = digits(v)
    return d.rlike("^(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{5}$") & luhn(F.substring(d, 1, 12)) & _verhoeff(F.concat(F.substring(d, 1, 11), F.substring(d, 13, 1)), 12)


def ie_pps(v: Column) -> Column:
    x = alnum(v)
    last = F.substring(x, 9, 1)
    total = dot(x, range(8, 1, -1)) + F.when(last.isin("", "W"), 0).otherwise((F.ascii(last) - 64) * 9)
    return x.rlike("^[0-9]{7}[A-W][A-IW]?$") & (F.substring(F.lit("WABCDEFGHIJKLMNOPQRSTUV"), total % 23 + 1, 1) == F.substring(x, 8, 1))


def be_vat(v: Column) -> Column:
    d = digits(v)
    return d.rlike("^[01][0-9]{9}$") & (97 - F.substring(d, 1, 8).cast("int") % 97 == F.substring(d, 9, 2).cast("int"))


def fr_vat(v: Column) -> Column:
    """A key from the company's number, whose own sum is Luhn's."""
    d = digits(v)
    number = F.substring(d, 3, 9)
    return (F.length(d) == 11) & siren(number) & ((12 + 3 * (number.cast("int") % 97)) % 97 == F.substring(d, 1, 2).cast("int"))


def it_vat(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 11) & luhn(d) & ~d.rlike("^0+$")


def se_vat(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 12) & d.endswith("01") & luhn(F.substring(d, 1, 10))


def rib(v: Column) -> Column:
    """French account numbers: bank, branch, account with letters as digits of a row of nine, key."""
    x = F.translate(alnum(v), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "12345678912345678923456789")
    part = lambda at, n: F.substring(x, at, n).cast("long")
    return alnum(v).rlike("^[0-9]{10}[0-9A-Z]{11}[0-9]{2}$") & ((89 * part(1, 5) + 15 * part(6, 5) + 3 * part(11, 11) + part(22, 2)) % 97 == 0)


def iccid(v: Column) -> Column:
    d = digits(v)
    return d.rlike("^89[0-9]{17,18}$") & luhn(d)


def npi(v: Column) -> Column:
    d = digits(v)
    return d.rlike("^[12][0-9]{9}$") & luhn(F.concat(F.lit("80840"), d))


def dea(v: Column) -> Column:
    x = alnum(v)
    d = F.substring(x, 3, 7)
    return x.rlike("^[A-Z][A-Z9][0-9]{7}$") & (dot(d, [1, 2, 1, 2, 1, 2]) % 10 == _at(d, 6))


def au_acn(v: Column) -> Column:
    return _ends(v, 9, range(8, 0, -1), 10)


def au_medicare(v: Column) -> Column:
    d = digits(v)
    return d.rlike("^[2-6][0-9]{9,10}$") & (dot(d, [1, 3, 7, 9, 1, 3, 7, 9]) % 10 == _at(d, 8))


def nz_ird(v: Column) -> Column:
    """Where the first weights lack 10, a second row decides."""
    d = F.lpad(digits(v), 9, "0")
    first, second = (_least_digit(dot(d, w), 11, {}) for w in ([3, 2, 7, 6, 5, 4, 3, 2], [7, 4, 3, 2, 5, 2, 7, 6]))
    return F.length(digits(v)).isin(8, 9) & digits(v).cast("int").between(10_000_000, 150_000_000) & (F.when(first < 10, first).otherwise(second) == _at(d, 8))


def hk_id(v: Column) -> Column:
    """Letters count from 10, a missing first letter 36; A stands for 10 at the end."""
    x = F.lpad(alnum(v), 9, " ")
    letter = lambda i: F.when(F.substring(x, i, 1) == " ", 36).otherwise(F.ascii(F.substring(x, i, 1)) - 55)
    last = F.when(F.substring(x, 9, 1) == "A", 10).otherwise(_at(x, 8))
    return x.rlike("^[ A-Z][A-Z][0-9]{6}[0-9A]$") & ((letter(1) * 9 + letter(2) * 8 + dot(x, [7, 6, 5, 4, 3, 2], 2) + last) % 11 == 0)


def jp_my_number(v: Column) -> Column:
    d = digits(v)
    rest = dot(d, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return (F.length(d) == 12) & (F.when(rest <= 1, 0).otherwise(11 - rest) == _at(d, 11))


def kr_rrn(v: Column) -> Column:
    d = digits(v)
    return d.rlike("^[0-9]{2}(?:0[1-9]|1[0-2])[0-9]{2}[1-8][0-9]{6}$") & ((11 - dot(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10 == _at(d, 12))


def cn_uscc(v: Column) -> Column:
    """Powers of 3 modulo 31 over an alphabet without I, O, S, V and Z."""
    x = alnum(v)
    value = lambda i: F.instr(F.lit("0123456789ABCDEFGHJKLMNPQRTUWXY"), F.substring(x, i + 1, 1)) - 1
    total = F.lit(0)
    for i in range(17):
        total = total + value(i) * pow(3, i, 31)
    return x.rlike("^[0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}$") & ((31 - total % 31) % 31 == value(17))


def mx_curp(v: Column) -> Column:
    x = alnum(v)
    total = F.lit(0)
    for i in range(17):
        total = total + (F.instr(F.lit("0123456789ABCDEFGHIJKLMN?OPQRSTUVWXYZ"), F.substring(x, i + 1, 1)) - 1) * (18 - i)
    return x.rlike("^[A-Z]{4}[0-9]{6}[HMX][A-Z]{5}[A-Z0-9][0-9]$") & ((10 - total % 10) % 10 == _at(x, 17))


def br_pis(v: Column) -> Column:
    return _ends(v, 11, [3, 2, 9, 8, 7, 6, 5, 4, 3, 2], 11, {10: 0})


def co_nit(v: Column) -> Column:
    d = digits(v)
    rest = dot(d, [41, 37, 29, 23, 19, 17, 13, 7, 3]) % 11
    return (F.length(d) == 10) & (F.when(rest > 1, 11 - rest).otherwise(rest) == _at(d, 9))


def ec_cedula(v: Column) -> Column:
    d = digits(v)
    return d.rlike("^(?:0[1-9]|1[0-9]|2[0-4]|30)[0-5][0-9]{7}$") & luhn(d)


def pe_ruc(v: Column) -> Column:
    d = digits(v)
    return d.rlike("^(?:10|15|16|17|20)[0-9]{9}$") & ((11 - dot(d, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11) % 10 == _at(d, 10))


def uy_ci(v: Column) -> Column:
    return _ends(v, 8, [2, 9, 8, 7, 6, 3, 4], 10)


def isbn10(v: Column) -> Column:
    x = alnum(v)
    last = F.when(F.substring(x, 10, 1) == "X", 10).otherwise(_at(x, 9))
    return x.rlike("^[0-9]{9}[0-9X]$") & ((dot(x, range(10, 1, -1)) + last) % 11 == 0)


def mrz(v: Column) -> Column:
    """The second line of a passport's machine-readable zone: number, birth and expiry each with a check digit of weights 7, 3, 1."""

    def closed(at: int, n: int) -> Column:
        total = F.lit(0)
        for i in range(n):
            c = F.substring(v, at + i, 1)
            value = F.when(c == "<", 0).when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
            total = total + value * (7, 3, 1)[i % 3]
        return total % 10 == F.substring(v, at + n, 1).cast("int")

    return v.rlike("^[A-Z0-9<]{9}[0-9][A-Z<]{3}[0-9]{7}[MFX<][0-9]{7}[A-Z0-9<]{14}[0-9<][0-9]$") & closed(1, 9) & closed(14, 6) & closed(22, 6)


def real_date(v: Column) -> Column:
    """Day, month and year, or the other way round, that a calendar has: of day and month either may come first."""
    p = F.split(v, "[./-]")
    a, b, c = (F.get(p, i).try_cast("int") for i in range(3))
    days = lambda day, month: day.between(1, F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)) & month.between(1, 12)
    return F.when(F.length(F.get(p, 0)) == 4, days(c, b)).otherwise(days(a, b) | days(b, a))


def us_phone(v: Column) -> Column:
    d = F.substring(digits(v), -10, 10)
    return F.length(digits(v)).isin(10, 11) & d.rlike("^[2-9][0-9]{2}[2-9]")


def intl_phone(v: Column) -> Column:
    return F.length(digits(v)).between(8, 15) & ~digits(v).rlike(r"^(\d)\1+$")


def mixed_token(v: Column) -> Column:
    """Letters and digits both, and not a plain word with a number behind it."""
    return v.rlike("[0-9]") & v.rlike("[G-Zg-z]") & ~v.rlike("^[A-Za-z]+[0-9]{1,4}$") & (F.size(F.array_distinct(F.split(v, ""))) >= 6)


def not_placeholder(v: Column) -> Column:
    return ~v.rlike(r"(?i)<[^>]*>|\$\{|\{\{|x{4,}|your[_-]|changeme|placeholder")


#: All checks by name.
CHECKS: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (
        luhn, card, iban, lei, isin, ipv4, siren, siret, ssn, nir, aba, nhs, dni, bsn, pesel, steuer_id, pt_nif, be_nrn, se_personnummer, no_fnr, fi_hetu,
        ch_ahv, ean13, it_codice_fiscale, ro_cnp, bg_egn, tr_tckn, cpf, cnpj, cuit, rut, resident_cn, abn, tfn, nric, za_id, il_id, sin, aadhaar, imei, vin,
        lat_long, us_phone, intl_phone, mixed_token, not_placeholder, th_id, mx_clabe, pl_nip, pl_regon, dk_cvr, no_orgnr, fi_ytunnus, is_kennitala, ee_isikukood,
        hr_oib, rs_jmbg, cz_rc, at_svnr, de_rvnr, gr_amka, lu_matricule, ie_pps, be_vat, fr_vat, it_vat, se_vat, rib, iccid, npi, dea, au_acn, au_medicare, nz_ird, hk_id,
        jp_my_number, kr_rrn, cn_uscc, mx_curp, br_pis, co_nit, ec_cedula, pe_ruc, uy_ci, isbn10, mrz, real_date,
    )
}
