"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Values are recognised by pattern and, where the kind has one, by its check: card numbers (Luhn), IBANs
(mod 97), IPv4 addresses (octets), phone and social security numbers (number plan), dates
(calendar), e-mail addresses and credentials (form). A valid value is written as an integer below
the number of valid values of its format, permuted there, and written back in the same layout: a
card stays a card with a right check digit, a date a date. The permutation is a Feistel network over
two mixed halves with a keyed hash as round function, walked on until the result lies in the domain, so it
is a bijection and can be undone with the key. It depends on the key, the kind and the format alone, so equal
values stay equal in all documents, whatever partition they are in.

Of a card or IBAN match that fails its check, shorter and later parts at group ends are tried. A
pseudonym is walked on until the rejected parts that overlap it still fail, so that undoing takes the same
ones. Secrets are hex strings of 16 to 64 digits after a credential word and ``=`` or ``:``. Phones
are +1 numbers, separated ten-digit numbers, and ``+`` numbers of other countries (the country code
stays); national numbers of other countries have no mark and stay. Day-first dates come before
month-first ones; a month-first date whose day is above 12 keeps such a day.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_EPOCH, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of range(size)."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.a = math.isqrt(max(size - 1, 0)) + 1
        self.b = -(-size // self.a)
        self.tag = hashlib.blake2b(f"{kind}:{size}".encode(), key=key[:64], digest_size=32).digest()

    def _f(self, rnd: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(rnd.to_bytes(2, "little") + x.to_bytes(40, "little"), key=self.tag, digest_size=48).digest(), "little")

    def permute(self, x: int) -> int:
        while True:
            u, v = divmod(x, self.b)
            for r in range(0, ROUNDS, 2):
                u = (u + self._f(r, v)) % self.a
                v = (v + self._f(r + 1, u)) % self.b
            x = u * self.b + v
            if x < self.size:                      # else walk on along the cycle
                return x

    def restore(self, y: int) -> int:
        while True:
            u, v = divmod(y, self.b)
            for r in range(ROUNDS - 2, -1, -2):
                v = (v - self._f(r + 1, u)) % self.b
                u = (u - self._f(r, v)) % self.a
            y = u * self.b + v
            if y < self.size:
                return y


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _luhn_digit(body: str) -> str:
    return next(c for c in "0123456789" if luhn_ok(body + c))


def iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = "0123456789abcdef"


class Pseudonyms:
    """Recognises and replaces values in one text; ``back=True`` undoes it."""

    KINDS = [
        ("email", r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
        ("credential", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
        ("secret", r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?[0-9A-Fa-f]{16,64}(?![0-9A-Za-z])"),
        ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
        ("date", r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)"),
        ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"),
        ("phone", r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
                  r"|(?<![\w+.(-])(?:\([2-9]\d{2}\)[ .-]?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}(?![\d-]|\.\d)"
                  r"|(?<![\d+])\+(?!1)[1-9](?:[ .-]?\(?\d\)?){7,14}(?!\d)"),
        ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
        ("card", r"(?<![\d])\d(?:[ -]?\d){12,18}(?!\d)"),
    ]
    _ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS))
    _NEAR = re.compile(r"[0-9@]+|AKIA|(?i:password|passwd|pwd|token|secret|api[_-]?key)")
    _TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back, self.nets = key, back, {}

    def _net(self, kind: str, size: int, x: int) -> int:
        net = self.nets.get((kind, size))
        if net is None:
            net = self.nets[(kind, size)] = Feistel(self.key, kind, size)
        return net.restore(x) if self.back else net.permute(x)

    def _mixed(self, kind: str, s: str, alphabets: list[str]) -> str:
        """Permute a string whose i-th sign is of the i-th alphabet."""
        x, size = 0, 1
        for c, a in zip(s, alphabets):
            x, size = x * len(a) + a.index(c), size * len(a)
        y, out = self._net(kind, size, x), []
        for a in reversed(alphabets):
            y, r = divmod(y, len(a))
            out.append(a[r])
        return "".join(reversed(out))

    def _by_class(self, kind: str, s: str) -> str:
        """Permute letters and digits within their classes; other signs stay."""
        at = [i for i, c in enumerate(s) if any(c in a for a in _CLASSES)]
        alphabets = [next(a for a in _CLASSES if s[i] in a) for i in at]
        # the format is the sequence of classes, so equal classes share a permutation
        kind += ":" + "".join(str(_CLASSES.index(a)) for a in alphabets)
        new, out = self._mixed(kind, "".join(s[i] for i in at), alphabets), list(s)
        for i, c in zip(at, new):
            out[i] = c
        return "".join(out)

    def _hex(self, s: str) -> str:
        """Permute a hex string; its spelling (lower, upper or mixed) stays."""
        if s != s.lower() and s != s.upper():
            return self._mixed("secret:" + "".join("0" if c < "A" else "a" if c > "Z" else "A" for c in s), s,
                               ["0123456789" if c < "A" else "abcdef" if c > "Z" else "ABCDEF" for c in s])
        upper, new = s != s.lower(), s.lower()
        while True:
            new = self._mixed(f"secret{len(s)}", new, [_HEX] * len(s))
            if not upper or not new.isdigit():                # upper case must show
                return new.upper() if upper else new

    @staticmethod
    def _parts(kind: str, s: str):
        """Parts of a match to try in order: the whole, then for cards runs of whole groups, for IBANs shorter ones."""
        if kind == "card":
            g = [m.span() for m in re.finditer(r"\d+", s)]
            for i in range(len(g)):
                for j in range(len(g) - 1, i - 1, -1):
                    if 13 <= sum(z - a for a, z in g[i:j + 1]) <= 19:
                        yield g[i][0], g[j][1]
        else:
            yield 0, len(s)
            if kind == "iban":
                yield from ((0, m.start()) for m in reversed(list(re.finditer(" ", s))))

    @staticmethod
    def _checked(kind: str, s: str) -> bool:
        """The check of a card or an IBAN."""
        if kind == "iban":
            flat = s.replace(" ", "")
            return 15 <= len(flat) <= 34 and iban_ok(flat)
        digits = "".join(c for c in s if c.isdigit())
        return luhn_ok(digits) and len(set(digits)) > 1

    @staticmethod
    def _refill(layout: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in layout)

    def value(self, kind: str, s: str) -> str | None:
        """The pseudonym of a valid value, else None."""
        digits = "".join(c for c in s if "0" <= c <= "9")
        d = "0123456789"
        if kind == "email":
            local, at, domain = s.partition("@")
            return self._by_class("email", local) + at + domain
        if kind == "credential":
            return "AKIA" + self._mixed("credential", s[4:], [d + _CLASSES[2]] * 16)
        if kind == "secret":
            at = re.search("[0-9A-Fa-f]{16,64}$", s).start()
            return s[:at] + self._hex(s[at:])
        if kind == "iban":
            flat = s.replace(" ", "")
            if not 15 <= len(flat) <= 34 or not iban_ok(flat):
                return None
            body = self._by_class("iban" + flat[:2], flat[4:])
            check = 98 - int("".join(str(int(c, 36)) for c in body + flat[:2] + "00")) % 97
            new = iter(f"{flat[:2]}{check:02d}{body}")
            return "".join(c if c == " " else next(new) for c in s)
        if kind == "date":
            y, m, dd = (s[:4], s[5:7], s[8:]) if s[4:5] == "-" else (s[6:], s[3:5], s[:2])
            late = "/" in s and int(m) > 12                   # month first, which only a day above 12 shows
            try:
                n = datetime.date(int(y), *((int(dd), int(m)) if late else (int(m), int(dd)))).toordinal() - _EPOCH
            except ValueError:
                return None
            if not 0 <= n < _DAYS:
                return None
            while True:
                n = self._net("date", _DAYS, n)
                new = datetime.date.fromordinal(_EPOCH + n)
                if not late or new.day > 12:
                    return new.strftime("%Y-%m-%d" if s[4:5] == "-" else "%m/%d/%Y" if late else "%d/%m/%Y" if "/" in s else "%d.%m.%Y")
        if kind == "ip":
            octets = [int(x) for x in s.split(".")]
            if max(octets) > 255:
                return None
            x = self._net("ip", 1 << 32, int.from_bytes(bytes(octets), "big"))
            return ".".join(str(b) for b in x.to_bytes(4, "big"))
        if kind == "phone":
            if s[0] != "+" or digits[0] == "1":
                rest, kept = digits[-10:], digits[:-10]
                # an area code that no number plan has (0.., 1..) stays one
                new = self._mixed("phone", rest, [d[2:], d, d] + [d] * 7) if rest[0] >= "2" else self._mixed("phone01", rest, [d[:2]] + [d] * 9)
                return self._refill(s, kept + new)
            cut = 1 if digits[0] == "7" else 2 if digits[:2] in self._TWO else 3
            kept, rest = digits[:cut], digits[cut:]
            new = self._mixed(f"phone+{kept}:{len(rest)}{'z' * (rest[0] == '0')}", rest, ["0" if rest[0] == "0" else d[1:]] + [d] * (len(rest) - 1))
            return self._refill(s, kept + new)
        if kind == "ssn":
            if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
                return None
            area = [a for a in range(1, 900) if a != 666]
            x = (area.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1
            x, last = divmod(self._net("ssn", len(area) * 99 * 9999, x), 9999)
            a, mid = divmod(x, 99)
            return f"{area[a]:03d}-{mid + 1:02d}-{last + 1:04d}"
        if not luhn_ok(digits) or len(set(digits)) == 1:
            return None
        body = digits[:1] + self._mixed(f"card{len(digits)}", digits[1:-1], [d] * (len(digits) - 2))
        return self._refill(s, body + _luhn_digit(body))

    def _windows(self, text: str):
        """Parts of the text that can hold a value: around digits, at signs and credential marks, out to white space."""
        end = -1
        start = None
        for m in self._NEAR.finditer(text):
            a, z = m.start(), m.end()
            if a > end:
                if start is not None:
                    yield start, end
                start = max(0, a - 80)
            end = min(len(text), z + 80)
        if start is not None:
            yield start, end

    def text(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds replaced in order of place."""
        hits, rejected, at = [], [], 0
        for a, z in self._windows(text):
            while a > at and not text[a - 1].isspace():      # whole values, whatever their length
                a -= 1
            while z < len(text) and not text[z].isspace():
                z += 1
            pos = max(a, at)
            while m := self._ANY.search(text, pos, z):
                kind, start, pos = m.lastgroup, m.start(), m.end()
                for i, j in self._parts(kind, m.group()):
                    new = self.value(kind, text[start + i:start + j])
                    if new is not None:
                        at = pos = start + j
                        hits.append([kind, start + i, at, new])
                        break
                    if kind in ("card", "iban"):
                        rejected.append([kind, start + i, text[start + i:start + j]])
                else:                                        # nothing in it: go on behind its first group
                    if kind in ("card", "iban"):
                        pos = start + re.match("[0-9A-Za-z]+", m.group()).end()
        if not hits:
            return text, []
        if rejected:
            # with two values in one rejected part, the second saw the first one's pseudonym: undo it first
            for h in reversed(hits) if self.back else hits:
                self._keep_rejected(h, rejected)
        out, at = [], 0
        for _, i, j, new in hits:
            out += [text[at:i], new]
            at = j
        return "".join(out) + text[at:], [h[0] for h in hits]

    def _keep_rejected(self, hit: list, rejected: list) -> None:
        """Walk a value on until the rejected parts that overlap it (in order of place, at most 60 signs long) fail again."""
        kind, i, j, new = hit
        lo, hi = (bisect.bisect_left(rejected, p, key=lambda r: r[1]) for p in (i - 60, j))
        near = [r for r in rejected[lo:hi] if r[1] + len(r[2]) > i] if len(new) == j - i else []
        while near:
            fits = ["".join(new[p - i] if i <= p < j else c for p, c in enumerate(r[2], r[1])) for r in near]
            if not any(self._checked(r[0], t) for r, t in zip(near, fits)):
                for r, t in zip(near, fits):
                    r[2] = t
                break
            new = self.value(kind, new)
        hit[3] = new


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` replaced, plus ``n_values`` and ``kinds`` (sorted, distinct, comma-joined).

    ``back=True`` restores the values with the same key. Null texts stay null with 0 values, empty ones
    empty; repeated rows come out alike; values that fail their check stay as they are. Columns with
    the two result names are replaced, others pass through. Whole texts are read; rows are independent, so
    there is no shuffle.
    """
    keep = [c for c in docs.columns if c not in ("n_values", "kinds")]
    src = docs.select(*[F.col(f"`{c}`").cast("string").alias(f"k{i}") if c == "text" else F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    text = f"k{keep.index('text')}"
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)

    def run(batches):
        p = Pseudonyms(key, back)
        for b in batches:
            res = [(None, []) if t is None else p.text(t) for t in b.column(text).to_pylist()]
            cols = [pa.array([r[0] for r in res], pa.string()) if c == text else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(r[1]) for r in res], pa.int64()), pa.array([",".join(sorted(set(r[1]))) for r in res], pa.string())],
                                             names=[*b.schema.names, "n_values", "kinds"])

    out = src.mapInArrow(run, f"{fields}, n_values long, kinds string")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_values", "kinds")
