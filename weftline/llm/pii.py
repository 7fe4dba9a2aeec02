"""Format-preserving pseudonyms of personal numbers, dates and addresses; DataFrame and SQL functions only.

Method. A text is cut before every place where one of the patterns begins, so a candidate that turns out invalid hides
none that begins inside it. Candidates are validated by kind: payment cards (Luhn), IBANs (mod 97), social security
numbers, North American and international phone numbers, IPv4 addresses, dates (digits or month names) and e-mail
addresses. From left to right each valid candidate that does not begin inside an accepted one is accepted; of several
kinds at one place the first of ``KINDS`` is. An accepted one is mapped to a pair of numbers below (ma, mb), which
together count exactly the values of its format, and permuted there by a keyed alternating Feistel network of
``ROUNDS`` rounds with SHA-256: a += F(b) mod ma, then b += F(a) mod mb. What comes back is valid in the same format
(separators, check digits, length, country, mail domain), and equal values get equal pseudonyms in every document.
:func:`restored` runs the rounds backwards.

Phone numbers of ten digits are permuted within their class (area from 100 on and exchange from 100 on; area below 100;
exchange below 100), so a dialable number stays one. International numbers keep country code and first digit. Dates from
1900-01-01 to 2079-06-06 are permuted among themselves, all others from year 1 to 9999 among the others.

Defined results: a null text stays null, an empty one empty; invalid candidates stay as they are; texts may have any
length (work is linear in it); a small format can map a value to itself; letters of a mail address become small, a day
written with one digit may come back with two; rows repeat as they are; extra columns are kept, but for ``n_<kind>``,
which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For tests; a production run passes its own secret, best as a frame (see :func:`pseudonymised`).
DEMO_KEY = "weftline demonstration key"
ROUNDS = 10
DAYS = 65_536
#: Characters of a candidate at most, and places inside one where another may begin.
LONGEST, INSIDE = 330, 110
#: Segments folded together.
BLOCK = 400

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
# Names of months by language, in order.
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
}
# Country calling codes of one and two digits; all others have three.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
_NAMES = "|".join(sorted({m for names in MONTHS.values() for m in names.split()}, key=lambda m: (-len(m), m)))
_MONTH = f"(?i:{_NAMES})"
# What must not stand before a candidate, the candidates' patterns, and what must not stand behind (Java).
BEFORE = {
    "email": r"(?<![A-Za-z0-9._%+-])", "iban": r"(?<![A-Za-z0-9])", "card": r"(?<![0-9A-Za-z])(?<![0-9][.-])", "ssn": r"(?<![0-9A-Za-z])(?<![0-9][.-])",
    "phone": r"(?<![0-9A-Za-z+])(?<![0-9][.])", "ip": r"(?<![0-9A-Za-z])(?<![0-9][.])", "date": r"(?<![\p{L}0-9])(?<![0-9][./-])",
}
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2}|[A-Z0-9]{11,30})",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{4,5})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+1[0-9]{10}|\+[1-9](?:[ .-]?(?:\([0-9]{1,4}\)|[0-9])){7,14})",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "date": rf"(?:[0-9]{{4}}([-/.])[0-9]{{2}}\1[0-9]{{2}}|[0-9]{{2}}([./-])[0-9]{{2}}\2[0-9]{{4}}|[0-9]{{1,2}}(?:\.|st|nd|rd|th)? (?:de )?{_MONTH},? (?:de )?[0-9]{{4}}|{_MONTH} [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}})",
}
#: Forms that begin alike: the first valid one counts. Other kinds have one form, their pattern.
FORMS = {
    "card": (r"[0-9]{13,19}", *(r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}" + x for x in ("", r"[ -][0-9]{3}")), *(rf"[0-9]{{4}}[ -]?[0-9]{{6}}[ -]?[0-9]{{{n}}}" for n in (5, 4))),
    "iban": (*(rf"[A-Z]{{2}}[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{g}}}{x}" for g in range(7, 1, -1) for x in (" [A-Z0-9]{1,3}", "")), r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"),
}
AFTER = {
    "email": r"(?![A-Za-z0-9-])", "iban": r"(?![A-Za-z0-9])", "card": r"(?![0-9A-Za-z])", "ssn": r"(?![0-9A-Za-z]|[.-][0-9])",
    "phone": r"(?![0-9A-Za-z]|[.-][0-9])", "ip": r"(?![0-9A-Za-z]|\.[0-9])", "date": r"(?![0-9A-Za-z]|[./-][0-9])",
}


def _power(base: int, most: int, n: str) -> str:
    """base ** n for n up to ``most``, exactly."""
    return f"get(array({', '.join(f'{base**i}L' for i in range(most + 1))}), cast({n} as int))"


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _digits(m: str) -> str:
    return rf"regexp_replace({m}, r'[^0-9]', '')"


def _refill(m: str, digits: str, kind: str = "[0-9]") -> str:
    """``m`` with its characters of ``kind`` replaced in turn by those of ``digits``."""
    step = f"case when c rlike r'{kind}' then struct(concat(r.o, substring({digits}, r.k, 1)) as o, r.k + 1 as k) else struct(concat(r.o, c) as o, r.k as k) end"
    return f"aggregate(split({m}, ''), struct('' as o, 1 as k), (r, c) -> {step}, r -> r.o)"


def _luhn(d: str) -> str:
    """Luhn sum of a digit string; 0 modulo 10 if valid."""
    v = f"cast(substring({d}, i, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + case when (length({d}) - i) % 2 = 1 then {v} * 2 - case when {v} > 4 then 9 else 0 end else {v} end)"


def _mod97(s: str) -> str:
    v = "case when c rlike '[0-9]' then cast(c as int) else ascii(c) - 55 end"
    return f"aggregate(split({s}, ''), 0, (s, c) -> (s * case when c rlike '[0-9]' then 10 else 100 end + {v}) % 97)"


#: SQL that tells whether the form ``m`` of a kind with several forms is valid.
VALID = {
    "card": _let(_digits("m"), "d", f"{_luhn('d')} % 10 = 0 and d rlike '[1-9]'"),
    "iban": _let("replace(m, ' ', '')", "d", f"length(d) between 15 and 34 and {_mod97('concat(substring(d, 5), left(d, 4))')} = 1"),
}


class Cipher:
    """SQL of the pseudonyms by kind: each of a candidate ``m``, null if it is not valid.

    ``key`` is the name of the column that has the key; ``back`` runs the rounds backwards.
    """

    def __init__(self, key: str, back: bool = False):
        self.key, self.back = key, back

    def permuted(self, a: str, b: str, ma: str, mb: str, tweak: str, then: str) -> str:
        """SQL of ``then`` over z.a and z.b, the permuted (a, b) below (ma, mb)."""
        f = lambda x: f"cast(conv(left(sha2(concat_ws('|', `{self.key}`, {tweak}, i, {x}), 256), 15), 16, 10) as bigint)"
        sign = "-" if self.back else "+"
        step = (
            f"case when i % 2 = 0 then struct(pmod(s.a {sign} {f('s.b')} % s.ma, s.ma) as a, s.b as b, s.ma as ma, s.mb as mb) "
            f"else struct(s.a as a, pmod(s.b {sign} {f('s.a')} % s.mb, s.mb) as b, s.ma as ma, s.mb as mb) end"
        )
        start = f"struct(cast({a} as bigint) as a, cast({b} as bigint) as b, cast({ma} as bigint) as ma, cast({mb} as bigint) as mb)"
        order = f"sequence({ROUNDS - 1}, 0, -1)" if self.back else f"sequence(0, {ROUNDS - 1})"
        return f"aggregate({order}, {start}, (s, i) -> {step}, z -> {then})"

    def digit_string(self, d: str, tweak: str) -> str:
        """A string of up to 30 digits, permuted among those of its length."""
        back = "concat(case when u0 > 0 then lpad(cast(z.a as string), u0, '0') else '' end, lpad(cast(z.b as string), length(d0) - u0, '0'))"
        body = self.permuted("coalesce(cast(nullif(left(d0, u0), '') as bigint), 0L)", "substring(d0, u0 + 1)", _power(10, 15, "u0"), _power(10, 15, "length(d0) - u0"), tweak, back)
        return _let(d, "d0", _let("length(d0) div 2", "u0", f"case when d0 = '' then '' else {body} end"))

    def letter_string(self, d: str, tweak: str, base: int, lower: bool) -> str:
        """A string of figures of ``base`` (0-9 and letters), permuted in pieces of 22 among those of its length."""
        part = lambda x, n: f"lpad(conv(cast(z.{x} as string), 10, {base}), {n}, '0')"
        back = f"concat(case when u > 0 then {part('a', 'u')} else '' end, {part('b', 'length(c) - u')})"
        chunk = self.permuted(f"coalesce(cast(conv(nullif(left(c, u), ''), {base}, 10) as bigint), 0L)", f"conv(substring(c, u + 1), {base}, 10)", _power(base, 11, "u"), _power(base, 11, "length(c) - u"), f"concat({tweak}, j)", back)
        chunks = f"array_join(transform(sequence(0, (length(l0) - 1) div 22), j -> {_let('substring(l0, j * 22 + 1, 22)', 'c', _let('length(c) div 2', 'u', chunk))}), '')"
        return _let(d, "l0", f"case when l0 = '' then '' else {f'lower({chunks})' if lower else f'upper({chunks})'} end")

    def card(self) -> str:
        body = self.digit_string("substring(d, 2, length(d) - 2)", "concat('card', left(d, 1))")
        new = _let(f"concat(left(d, 1), {body})", "e", f"concat(e, cast((10 - {_luhn("concat(e, '0')")} % 10) % 10 as string))")
        return _let(_digits("m"), "d", _let(new, "n", _refill("m", "n")))

    def iban(self) -> str:
        """Digits among digits, letters among letters, new check digits; the country stays."""
        figures, letters = "0123456789ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        nd = self.digit_string(_digits("substring(d, 5)"), "concat('iban', left(d, 2))")
        nl = self.letter_string(f"translate(regexp_replace(substring(d, 5), '[0-9]', ''), '{letters}', '{figures}')", "concat('ibanl', left(d, 2))", 26, False)
        body = _let(nd, "nd", _let(f"translate({nl}, '{figures}', '{letters}')", "nl", _let(_refill("substring(d, 5)", "nd"), "b0", _refill("b0", "nl", "[A-Z]"))))
        check = f"lpad(cast(98 - {_mod97("concat(b, left(d, 2), '00')")} as string), 2, '0')"
        return _let("replace(m, ' ', '')", "d", _let(_let(body, "b", f"concat(left(d, 2), {check}, b)"), "n", _refill("m", "n", "[^ ]")))

    def ssn(self) -> str:
        area, group, serial = (f"cast(substring(m, {i}, {k}) as int)" for i, k in ((1, 3), (5, 2), (8, 4)))
        valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
        a = f"({area} - 1 - case when {area} > 666 then 1 else 0 end) * 99 + {group} - 1"
        back = "concat(lpad(cast((z.a div 99) + 1 + case when z.a div 99 >= 665 then 1 else 0 end as string), 3, '0'), '-', lpad(cast(z.a % 99 + 1 as string), 2, '0'), '-', lpad(cast(z.b + 1 as string), 4, '0'))"
        return f"case when {valid} then {self.permuted(a, f'{serial} - 1', str(898 * 99), '9999', "'ssn'", back)} end"

    def phone(self) -> str:
        area, line = "cast(left(p, 3) as int)", "cast(substring(p, 4) as int)"
        # Tweak, least area and number of areas, least line and number of lines of each class.
        kind = lambda *v: "struct('{}' as w, {} as a0, {} as na, {} as b0, {} as nb)".format(*v)
        classes = f"case when {area} < 100 then {kind('phone0', 0, 100, 0, 10_000_000)} when {line} < 1000000 then {kind('phone1', 100, 900, 0, 1_000_000)} else {kind('phone', 100, 900, 1_000_000, 9_000_000)} end"
        back = "concat(substring(d, 1, length(d) - 10), lpad(cast(z.a + y.a0 as string), 3, '0'), lpad(cast(z.b + y.b0 as string), 7, '0'))"
        american = _let(classes, "y", self.permuted(f"{area} - y.a0", f"{line} - y.b0", "y.na", "y.nb", "y.w", back))
        code = " ".join(f"when left(d, {len(c)}) = '{c}' then {len(c)}" for c in CODES.split())
        foreign = _let(f"case {code} else 3 end", "cc", f"concat(left(d, cc + 1), {self.digit_string('substring(d, cc + 2)', "concat('tel', left(d, cc + 1))")})")
        new = f"case when length(d) = 10 or (length(d) = 11 and left(d, 1) = '1') then {_let('right(d, 10)', 'p', american)} when left(m, 1) = '+' and length(d) between 8 and 15 then {foreign} end"
        return _let(_digits("m"), "d", _let(new, "n", f"case when n is not null then {_refill('m', 'n')} end"))

    def ip(self) -> str:
        back = "concat_ws('.', z.a div 256, z.a % 256, z.b div 256, z.b % 256)"
        new = self.permuted("get(o, 0) * 256 + get(o, 1)", "get(o, 2) * 256 + get(o, 3)", "65536", "65536", "'ip'", back)
        return _let("transform(split(m, '[.]'), x -> cast(x as int))", "o", f"case when array_max(o) < 256 then {new} end")

    def _moved(self, day: str) -> str:
        """The date for which the date ``day`` stands, null outside the years 1 to 9999."""
        first, n = "date'0001-01-01'", f"datediff({day}, date'1900-01-01')"
        # All days but the near ones, without a gap: 3,586,523 = 6,439 * 557 of them from year 1 to 9999.
        k = f"datediff({day}, {first}) - case when {n} >= {DAYS} then {DAYS} else 0 end"
        sizes = f"case when {n} between 0 and {DAYS - 1} then struct('date' as w, {n} as n, 256 as na, 256 as nb) else struct('far' as w, {k} as n, 6439 as na, 557 as nb) end"
        at = "cast(z.a * y.nb + z.b as int)"
        back = f"case when y.w = 'date' then date_add(date'1900-01-01', {at}) else date_add({first}, {at} + case when {at} >= datediff(date'1900-01-01', {first}) then {DAYS} else 0 end) end"
        return f"case when {day} between {first} and date'9999-12-31' then {_let(sizes, 'y', self.permuted('y.n div y.nb', 'y.n % y.nb', 'y.na', 'y.nb', 'y.w', back))} end"

    def date(self) -> str:
        """Year first; else day before month if that is a date, else month before day; else with the month's name.

        A date that can only be read month first is permuted until it comes to another such date, so it is read again as written.
        """
        made = lambda y, mo, d: f"try_to_date(concat_ws('-', {y}, lpad({mo}, 2, '0'), lpad({d}, 2, '0')), 'yyyy-MM-dd')"
        dmy, mdy = made("right(m, 4)", "substring(m, 4, 2)", "substring(m, 1, 2)"), made("right(m, 4)", "substring(m, 1, 2)", "substring(m, 4, 2)")
        iso = made("left(m, 4)", "substring(m, 6, 2)", "substring(m, 9, 2)")
        word = rf"regexp_extract(m, r'({_MONTH})', 1)"
        lists = "array(" + ", ".join("array(" + ", ".join(f"'{x}'" for x in names.split()) + ")" for names in MONTHS.values()) + ")"
        names = f"get(filter({lists}, q -> array_contains(transform(q, y -> lower(y)), lower(w))), 0)"
        dd = r"regexp_extract(regexp_replace(m, r'[0-9]{4}$', ''), r'([0-9]{1,2})', 1)"
        named = made("right(m, 4)", "cast(array_position(transform(ns, y -> lower(y)), lower(w)) as string)", dd)
        read = f"case when w <> '' then struct({named} as t, 'name' as f) when m rlike '^[0-9]{{4}}' then struct({iso} as t, 'yyyyMMdd' as f) when {dmy} is not null then struct({dmy} as t, 'ddMMyyyy' as f) else struct({mdy} as t, 'MMddyyyy' as f) end"
        walk = f"aggregate(sequence(1, 200), struct(r.t as t, false as done), (a, i) -> case when a.done then a else {_let(self._moved('a.t'), 'x', "struct(x as t, r.f <> 'MMddyyyy' or day(x) > 12 as done)")} end, a -> a.t)"
        # The new name is written as the old one was: small, capital or all capitals.
        cased = "case when w = upper(w) and length(w) > 1 then upper(x) when left(w, 1) = upper(left(w, 1)) then concat(upper(left(x, 1)), substring(x, 2)) else lower(x) end"
        shown_day = f"case when {dd} rlike '^0' then lpad(cast(day(t) as string), 2, '0') else cast(day(t) as string) end"
        pieces = rf"concat(regexp_replace(substring(m, 1, length(m) - 4), r'(?:[0-9]{{1,2}})(?=\D*$)', {shown_day}), lpad(cast(year(t) as string), 4, '0'))"
        put = f"replace({pieces}, w, {_let('get(ns, month(t) - 1)', 'x', cased)})"
        formed = " ".join(f"when '{f}' then date_format(t, '{f}')" for f in ("yyyyMMdd", "ddMMyyyy", "MMddyyyy"))
        shown = f"case when t is null then null when r.f = 'name' then {put} else {_let(f'case r.f {formed} end', 'n', _refill('m', 'n'))} end"
        return _let(word, "w", _let(f"case when w <> '' then {names} end", "ns", _let(read, "r", f"case when r.t is not null then {_let(walk, 't', shown)} end")))

    def email(self) -> str:
        local = "regexp_replace(lower(substring_index(m, '@', 1)), r'[^a-z0-9]', '')"
        return _let(local, "d", f"case when d <> '' then concat({_let(self.letter_string('d', "'email'", 36, True), 'n', _refill("substring_index(m, '@', 1)", 'n', '[A-Za-z0-9]'))}, '@', substring_index(m, '@', -1)) end")


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "''") + "'"


def _renumbered(pattern: str, groups: int) -> str:
    """``pattern`` with its back references moved by ``groups``."""
    return pattern.replace(r"\2", rf"\{2 + groups}").replace(r"\1", rf"\{1 + groups}")


def _run(docs: DataFrame, key: str | DataFrame, text_col: str, back: bool) -> DataFrame:
    made = [f"n_{k}" for k in KINDS]
    src = docs.drop(*made)
    fresh = lambda name: next(n for n in (name + "_" * i for i in range(len(src.columns) + 1)) if n not in src.columns)
    k, found = fresh("pii_key"), fresh("pii_found")
    cipher = Cipher(k, back)
    src = src.withColumn(k, key.select(key.columns[0]).scalar() if isinstance(key, DataFrame) else F.lit(key))
    # A text without a digit or an at sign has no candidate.
    starts = "(?=" + "|".join(f"(?:{BEFORE[x]}{PATTERNS[x]}{AFTER[x]})" for x in KINDS) + ")"
    segs = f"case when `{text_col}` rlike '[0-9@]' then split(`{text_col}`, {_sql(starts)}, -1) end"
    first = lambda x, p: f"regexp_extract(h, {_sql(f'^({_renumbered(p, 1)}){AFTER[x]}')}, 1)"
    form = lambda x: f"coalesce(get(filter(array({', '.join(first(x, p) for p in FORMS[x])}), m -> m <> '' and {VALID[x]}), 0), '')" if x in FORMS else first(x, PATTERNS[x])
    one = "coalesce(" + ", ".join(_let(form(x), "m", f"case when m <> '' then {_let(getattr(cipher, x)(), 'x', f"case when x is not null then struct(x as n, length(m) as k, '{x}' as kind) end")} end") for x in KINDS) + ")"
    # The head of a segment, with those behind it as far as a candidate reaches.
    ahead = f"case when length(s) >= {LONGEST} then left(s, {LONGEST}) else array_join(slice(heads, i + 1, {INSIDE}), '') end"
    valid = _let(f"transform(segs, s -> left(s, {LONGEST}))", "heads", f"transform(segs, (s, i) -> struct(s as s, {_let(ahead, 'h', one)} as v))")
    piece = (
        "case when a.skip > 0 then struct(greatest(a.skip - length(x.s), 0) as skip, concat(a.out, array(struct(substring(x.s, a.skip + 1) as p, cast(null as string) as kind))) as out) "
        "when x.v is not null then struct(greatest(x.v.k - length(x.s), 0) as skip, concat(a.out, array(struct(concat(x.v.n, substring(x.s, x.v.k + 1)) as p, x.v.kind as kind))) as out) "
        "else struct(a.skip as skip, concat(a.out, array(struct(x.s as p, cast(null as string) as kind))) as out) end"
    )
    none = "cast(array() as array<struct<p:string,kind:string>>)"
    block = f"aggregate(slice(vs, b * {BLOCK} + 1, {BLOCK}), struct(o.skip as skip, {none} as out), (a, x) -> {piece})"
    outer = f"aggregate(sequence(0, (size(vs) - 1) div {BLOCK}), struct(0 as skip, cast(array() as array<array<struct<p:string,kind:string>>>) as out), (o, b) -> {_let(block, 'r', 'struct(r.skip as skip, concat(o.out, array(r.out)) as out)')}, o -> flatten(o.out))"
    folded = _let(valid, "vs", f"case when exists(vs, x -> x.v is not null) then {outer} end")
    src = src.withColumn(found, F.expr(_let(segs, "segs", f"case when segs is not null then {folded} end")))
    src = src.withColumn(text_col, F.expr(f"case when `{found}` is null then `{text_col}` else array_join(transform(`{found}`, x -> x.p), '') end"))
    counts = {f"n_{x}": F.expr(f"cast(case when `{found}` is null then 0 else size(filter(`{found}`, x -> x.kind = '{x}')) end as bigint)") for x in KINDS}
    return src.withColumns(counts).drop(found, k)


def pseudonymised(docs: DataFrame, key: str | DataFrame = DEMO_KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and ``n_<kind>``, how many of each kind were replaced.

    ``key`` is the secret, or a frame whose only row has it in its first column (a table of secrets): a string stands
    in query plans and event logs, a frame's value does not.
    """
    return _run(docs, key, text_col, False)


def restored(docs: DataFrame, key: str | DataFrame = DEMO_KEY, text_col: str = "text") -> DataFrame:
    """The inverse of :func:`pseudonymised` under the same key."""
    return _run(docs, key, text_col, True)


def op5(spark, docs: DataFrame) -> DataFrame:
    """Every document with pseudonyms instead of valid personal numbers, dates and addresses."""
    return pseudonymised(docs.select("doc_id", "text"))
