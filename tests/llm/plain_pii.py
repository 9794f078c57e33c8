"""The pseudonyms once more in plain Python, value by value."""

import hashlib
import unicodedata
from datetime import date, timedelta

import regex

L, N = r"\p{L}", r"\p{N}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
W, D = "[A-Za-z0-9_]", "[0-9]"
KINDS = {
    "email": rf"(?<![{L}{N}._%+-])[{L}{N}._%+-]++@[{L}{N}-]++(?:\.[{L}{N}-]++)+",
    "ip": rf"(?<![A-Za-z0-9_.])(?:{OCTET}\.){{3}}{OCTET}(?!{W}|\.{D})",
    "date": rf"(?<![A-Za-z0-9_/-])(?:{D}{{4}}-{D}{{2}}-{D}{{2}}|{D}{{2}}/{D}{{2}}/{D}{{4}}|{D}{{2}}\.{D}{{2}}\.{D}{{4}})(?![A-Za-z0-9_/-]|\.{D})",
    "ssn": rf"(?<![A-Za-z0-9_-])(?!000|666|9){D}{{3}}-(?!00){D}{{2}}-(?!0000){D}{{4}}(?![A-Za-z0-9_-])",
    "phone": rf"(?<![A-Za-z0-9_+])(?:\+{D}{{1,3}}[ .-]?)?\({D}{{3}}\)[ .-]?{D}{{3}}[ .-]{D}{{4}}(?!{D})|(?<![A-Za-z0-9_+])\+{D}{{1,3}}(?:[ .-]?{D}{{2,4}}){{2,4}}(?!{D})|(?<![A-Za-z0-9_.+-]){D}{{3}}[.-]{D}{{3}}[.-]{D}{{4}}(?![A-Za-z0-9_-])",
    "secret": r"""(?i:(?:token|secret|password|passwd|api[_-]?key)[ \t\n\x0b\f\r]{0,3}[=:][ \t\n\x0b\f\r]{0,3}["'][^"' \t\n\x0b\f\r]{8,}+["'])""",
}


def prf(key, *parts):
    return int(hashlib.sha256("|".join([key, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def move(c, by, text):
    for letters in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if text is True else (text,):
        if c in letters:
            return letters[(letters.index(c) + by) % len(letters)]
    if text is True and c > "\x7f" and unicodedata.category(c)[0] in "LN":
        base, off = ord(c) // 128 * 128, ord(c) % 128
        return next(x for i in range(1, 129) if unicodedata.category(x := chr(base + (off + i * (by % 64 * 2 + 1)) % 128)) == unicodedata.category(c))
    return c


def permuted(x, key, text=True):
    left, right = x[: len(x) // 2], x[len(x) // 2 :]
    for k in range(1, 9):
        told = hashlib.sha256(right.encode()).hexdigest() if len(right) > 100 else right
        left, right = right, "".join(move(c, prf(key, k, i, len(left), told), text) for i, c in enumerate(left))
    return left + right


def pair(l, r, sizes, key):
    for k in range(1, 5):
        l = (l + prf(key, k, "l", r)) % sizes[0]
        r = (r + prf(key, k, "r", l)) % sizes[1]
    return l, r


def refilled(shape, digits):
    left = iter(digits)
    return "".join(next(left, "") if c in "0123456789" else c for c in shape)


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def day(x):
    for shape, order in ((r"(\d{4})-(\d\d)-(\d\d)", "ymd"), (r"(\d\d)/(\d\d)/(\d{4})", "dmy"), (r"(\d\d)/(\d\d)/(\d{4})", "mdy"), (r"(\d\d)\.(\d\d)\.(\d{4})", "dmy")):
        if found := regex.fullmatch(shape, x):
            part = dict(zip(order, map(int, found.groups())))
            try:
                return date(part["y"], part["m"], part["d"]), order
            except ValueError:
                continue
    return None, None


def kind_of(x):
    for name in ("email", "ip", "date", "ssn", "phone", "card", "secret"):
        if name == "card":
            if regex.fullmatch(r"[0-9](?:[ -]?[0-9]){12,18}", x):
                return "card" if luhn(regex.sub("[^0-9]", "", x)) % 10 == 0 else None
        elif regex.fullmatch(KINDS[name], x):
            if name != "date":
                return name
            when = day(x)[0]
            return "date" if when and 0 <= (when - date(1000, 1, 1)).days < 730_000 else None
    return None


def pseudonym(x, kind, key):
    digits = regex.sub("[^0-9]", "", x)
    if kind == "email":
        local = x.split("@")[0]
        return permuted(local, f"{key}email") + x[len(local) :]
    if kind == "ip":
        a, b, c, d = map(int, x.split("."))
        l, r = pair(a * 256 + b, c * 256 + d, (65536, 65536), f"{key}ip")
        return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
    if kind == "date":
        when, order = day(x)
        n = (when - date(1000, 1, 1)).days
        l, r = pair(n // 1000, n % 1000, (730, 1000), f"{key}date")
        new = date(1000, 1, 1) + timedelta(l * 1000 + r)
        mark = next(c for c in x if not c.isdigit())
        show = {"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}
        return mark.join(show[p] for p in order)
    if kind == "ssn":
        a, g, s = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        l, r = pair(a - 1 - (a > 666), (g - 1) * 9999 + s - 1, (898, 99 * 9999), f"{key}ssn")
        return f"{l + 1 + (l >= 665):03}-{r // 9999 + 1:02}-{r % 9999 + 1:04}"
    if kind == "phone":
        code = len(m[1]) if (m := regex.match(r"\+([0-9]{1,3})(?=[^0-9])", x)) else 0
        return refilled(x, digits[:code] + permuted(digits[code:], f"{key}phone", "0123456789"))
    if kind == "card":
        body = digits[0] + permuted(digits[1:-1], f"{key}card", "0123456789")
        return refilled(x, body + str(-luhn(body + "0") % 10))
    if kind == "secret":
        head = regex.match("[^\"']*[\"']", x)[0]
        value = x[len(head) : -1]
        if regex.fullmatch("[0-9a-f]+", value):
            new = permuted(value, f"{key}hex", "0123456789abcdef")
        elif regex.fullmatch("[0-9A-F]+", value):
            new = permuted(value, f"{key}hex", "0123456789ABCDEF")
        else:
            new = permuted(value, f"{key}secret")
        return head + new + x[-1]
    return x


def pseudonymised(text, key):
    """(text, number of values)"""
    if text is None:
        return None, 0
    cards = set()
    for run in regex.finditer(r"(?<![A-Za-z0-9_.+-])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z0-9_])(?:[ -][0-9]++(?![A-Za-z0-9_]))*+", text):
        parts = regex.split(r"(?<=[ -])", run[0], flags=regex.V1)
        for i in range(len(parts)):
            for k in range(1, 20):
                piece = regex.sub("[ -]$", "", "".join(parts[i : i + k]))
                digits = regex.sub("[^0-9]", "", piece)
                if 13 <= len(digits) <= 19 and luhn(digits) % 10 == 0:
                    cards.add(piece)
    pattern = "|".join(KINDS.values())
    if cards:
        pattern += "|(?<![A-Za-z0-9_.+]|(?<![0-9])-)(?:" + "|".join(sorted(cards, key=lambda c: (-len(c), c), reverse=False)) + ")(?![A-Za-z0-9_])"
    n, out, at = 0, [], 0
    for m in regex.finditer(pattern, text):
        kind = kind_of(m[0])
        n += kind is not None
        out += [text[at : m.start()], pseudonym(m[0], kind, key)]
        at = m.end()
    return "".join(out) + text[at:], n
