"""Identifier punycode: RFC 3492 with `_` as the delimiter and letters a-z, A-J as digits 0-35. Characters that a symbol can't hold travel as code points from 0xD800 on."""

from __future__ import annotations

BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ"
HIDDEN = 0xD800


def _adapt(delta: int, points: int, first: bool) -> int:
    delta = delta // (DAMP if first else 2)
    delta += delta // points
    k = 0
    while delta > ((BASE - T_MIN) * T_MAX) // 2:
        delta //= BASE - T_MIN
        k += BASE
    return k + (BASE - T_MIN + 1) * delta // (delta + SKEW)


def _threshold(k: int, bias: int) -> int:
    return max(T_MIN, min(T_MAX, k - bias))


def symbol_char(c: str) -> bool:
    return c in "_$" or c.isascii() and c.isalnum()


def encode(text: str) -> str:
    points = [ord(c) if ord(c) >= 128 or symbol_char(c) else ord(c) + HIDDEN for c in text]
    basic = [chr(p) for p in points if p < FIRST]
    out = basic + (["_"] if basic else [])
    n, delta, bias, done = FIRST, 0, BIAS, len(basic)
    while done < len(points):
        m = min(p for p in points if p >= n)
        delta += (m - n) * (done + 1)
        n = m
        for p in points:
            if p < n:
                delta += 1
            elif p == n:
                q, k = delta, BASE
                while q >= (t := _threshold(k, bias)):
                    out.append(DIGITS[t + (q - t) % (BASE - t)])
                    q, k = (q - t) // (BASE - t), k + BASE
                out.append(DIGITS[q])
                bias = _adapt(delta, done + 1, done == len(basic))
                delta, done = 0, done + 1
        delta, n = delta + 1, n + 1
    return "".join(out)


def decode(text: str) -> str | None:
    """None when `text` isn't well formed."""
    head, mark, tail = text.rpartition("_")
    points = [ord(c) for c in head] if mark else []
    tail = tail if mark else text
    if any(p >= FIRST for p in points):
        return None
    n, i, bias, at = FIRST, 0, BIAS, 0
    while at < len(tail):
        old, weight, k = i, 1, BASE
        while True:
            if at >= len(tail) or (digit := DIGITS.find(tail[at])) < 0:
                return None
            at += 1
            i += digit * weight
            t = _threshold(k, bias)
            if digit < t:
                break
            weight *= BASE - t
            k += BASE
        bias = _adapt(i - old, len(points) + 1, old == 0)
        n += i // (len(points) + 1)
        i %= len(points) + 1
        if n > 0x10FFFF:
            return None
        points.insert(i, n)
        i += 1
    try:
        return "".join(chr(p - HIDDEN) if HIDDEN <= p < HIDDEN + 0x80 else chr(p) for p in points if not HIDDEN + 0x80 <= p < 0xE000)
    except ValueError:
        return None
