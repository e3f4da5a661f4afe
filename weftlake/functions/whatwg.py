"""Urls by the URL standard: parsed, resolved against a base and written again. A small helper that Arrow batches call once a url (see operators.page.resolve)."""

from __future__ import annotations

import re
from typing import NamedTuple

#: The special schemes with their default ports.
SPECIAL = {"ftp": 21, "file": None, "http": 80, "https": 443, "ws": 80, "wss": 443}
#: What each part percent-encodes beside controls and all beyond ASCII.
FRAGMENT, QUERY, SPECIAL_QUERY, PATH, USER = (frozenset(x.encode()) for x in (' "<>`', ' "#<>', " \"#<>'", ' "#<>?^`{}', ' "#<>?^`{}/:;=@[\\]|'))
_BAD_HOST = frozenset("\0\t\n\r #/:<>?@[\\]^|")
_DOT, _DOTS = frozenset((".", "%2e")), frozenset(("..", ".%2e", "%2e.", "%2e%2e"))


class Url(NamedTuple):
    scheme: str
    user: str | None  # with its password, as written
    host: str | None
    port: int | None
    path: list[str] | str  # a text where it is opaque
    query: str | None
    fragment: str | None

    def href(self) -> str:
        path = self.path if isinstance(self.path, str) else "".join("/" + s for s in self.path)
        at = "//" + (f"{self.user}@" if self.user else "") + self.host + (f":{self.port}" if self.port is not None else "") if self.host is not None else ""
        if self.host is None and path.startswith("//"):
            at = "/."
        return f"{self.scheme}:{at}{path}" + (f"?{self.query}" if self.query is not None else "") + (f"#{self.fragment}" if self.fragment is not None else "")


def encode(text: str, also: frozenset[int]) -> str:
    return "".join(chr(b) if 0x20 <= b <= 0x7E and b not in also else f"%{b:02X}" for b in text.encode("utf-8", "replace"))


def _ipv4(host: str) -> str | None | bool:
    """The address as four numbers, False where the host isn't meant as one, None where it is a wrong one."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not re.fullmatch(r"\d+|0[xX][0-9A-Fa-f]*", parts[-1]):
        return False
    numbers = []
    for p in parts:
        digits, base = (p[2:] or "0", 16) if p[:2] in ("0x", "0X") else (p[1:], 8) if len(p) > 1 and p[0] == "0" else (p, 10)
        try:
            if not p or not re.fullmatch("[0-9A-Fa-f]+", digits):
                return None
            numbers.append(int(digits, base))
        except ValueError:
            return None
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    whole = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(whole >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str) -> str | None:
    import ipaddress

    try:
        if "%" in text:
            return None
        n = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    groups = [n >> s & 0xFFFF for s in range(112, -1, -16)]
    runs = [(len(m[0]), -m.start()) for m in re.finditer("z{2,}", "".join("z" if g == 0 else "x" for g in groups))]
    words = [f"{g:x}" for g in groups]
    if not runs:
        return "[" + ":".join(words) + "]"
    length, start = max(runs)
    return "[" + ":".join(words[:-start]) + "::" + ":".join(words[-start + length :]) + "]"


def _host(text: str, special: bool) -> str | None:
    from urllib.parse import unquote_to_bytes

    if text.startswith("["):
        return _ipv6(text[1:-1]) if text.endswith("]") else None
    if not special:
        return None if set(text) & _BAD_HOST else encode(text, frozenset())
    try:
        name = unquote_to_bytes(text).decode("utf-8")
        name = name.lower() if name.isascii() else re.sub("[。．｡]", ".", name).encode("idna").decode().lower()
    except (UnicodeError, ValueError):
        return None
    if not name or set(name) & _BAD_HOST or any(c < " " or c in "%\x7f" for c in name):
        return None
    four = _ipv4(name)
    return name if four is False else four


def _segments(text: str, base: list[str], special: bool) -> list[str]:
    """base with the path's segments walked: one dot stays, two go up."""
    out, parts = list(base), re.split(r"[/\\]" if special else "/", text)
    for i, s in enumerate(parts):
        last, low = i == len(parts) - 1, s.lower()
        if low in _DOTS:
            if out:
                out.pop()
            if last:
                out.append("")
        elif low in _DOT:
            if last:
                out.append("")
        else:
            out.append(encode(s, PATH))
    return out


def parse(text: str, base: Url | None = None) -> Url | None:
    """The url, or None where the standard fails."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", text)
    scheme, rest = (m[1].lower(), text[m.end() :]) if m else (None, text)
    rest, mark, fragment = rest.partition("#")
    fragment = encode(fragment, FRAGMENT) if mark else None
    if scheme is None and base is None:
        return None
    special = (scheme or base.scheme) in SPECIAL
    slash = "/\\" if special else "/"
    body, mark, query = rest.partition("?")
    opaque = scheme is not None and not special and not body.startswith("/")
    query = encode(query, SPECIAL_QUERY if special else QUERY) if mark else None
    if opaque:
        return Url(scheme, None, None, None, encode(body, frozenset()), query, fragment)
    relative = scheme is None or (special and base is not None and scheme == base.scheme and scheme != "file" and body[:1] not in ("/", "\\") and isinstance(base.path, list))
    if scheme is None and isinstance(base.path, str):
        return base._replace(fragment=fragment) if not rest and fragment is not None else None
    double = len(body) > 1 and body[0] in slash and body[1] in slash
    if relative and not double:
        if not body:
            return base._replace(query=query if mark else base.query, fragment=fragment)
        path = _segments(body[1:], [], special) if body[0] in slash else _segments(body, base.path[:-1], special)
        return base._replace(path=path, query=query, fragment=fragment)
    scheme = scheme or base.scheme
    if special and scheme != "file":
        after = body.lstrip(slash)
    elif double:
        after = body[2:]
    elif scheme == "file":
        return Url(scheme, None, "", None, _segments(body.lstrip(slash), [], True), query, fragment)
    else:
        return Url(scheme, None, None, None, _segments(body[1:], [], False), query, fragment)
    authority = re.match(r"[^/\\]*" if special else "[^/]*", after)[0]
    path = after[len(authority) :]
    user, at, place = authority.rpartition("@")
    name, password = (user.split(":", 1) + [""])[:2]
    user = (encode(name, USER) + (f":{encode(password, USER)}" if password else "")) if at else ""
    m = re.fullmatch(r"(\[.*\]|[^:]*)(?::(\d*))?", place)
    if not m or (m[2] and int(m[2][:6]) > 65535) or (not m[1] and (special and scheme != "file" or m[2] is not None or at)):
        return None
    host = _host(m[1], special) if m[1] else ""
    if host is None:
        return None
    port = int(m[2]) if m[2] else None
    segments = _segments(path[1:], [], special) if path else ([""] if special else [])
    return Url(scheme, user or None, "" if scheme == "file" and host == "localhost" else host, None if port == SPECIAL.get(scheme) else port, segments, query, fragment)
