"""Plain versions of the operators for small tables, written from their contracts."""

from __future__ import annotations

import base64
import collections
import functools
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WHITE = " \t\n\x0b\x0c\r"
_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text: str) -> str:
    return text.translate(_UP)


def tokenizer() -> Tokenizer:
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def bpe(rows):
    """{(doc_id, n_tokens, ids sha, text sha)} of (doc_id, text)."""
    tok, out = tokenizer(), []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out


def token_file(rows):
    """(doc_id, start, n_tokens, crc) in ascending doc_id order."""
    tok, out, start = tokenizer(), [], 0
    for doc_id, text in sorted(rows):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(ids: list, linked) -> list:
    """The smallest id reachable from each, by asking ``linked(i, j)`` of all pairs."""
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                up[root(i)] = root(j)
    least: dict = {}
    for i, x in enumerate(ids):
        least.setdefault(root(i), []).append(x)
    return [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(ids))]


def components(prints: list[int], ids: list, radius: int = 4) -> list:
    return grouped(ids, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= radius)


def near_copies(texts: list, ids: list, shingle: int = 5) -> list:
    """By the Jaccard similarity of shingle sets, 0.8 or more; texts without words are alike."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) for t in texts]
    sets = [{tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} for w in words]
    return grouped(ids, lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))


def line_dedup(rows):
    """(doc_id, lines, kept lines) of (doc_id, text); a doc_id of None is after all others."""
    key = lambda line: lower(line.strip(WHITE))
    order = lambda d: (d is None, d or 0)
    holders: dict = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        gone = lambda k: len(holders.get(k, ())) >= 2 and min(holders[k], key=order) != d
        out.append((d, lines, [x for x in lines if not gone(key(x))]))
    return out


def pages(rows):
    """(page_id, bytes, digest, type, refers_to) of (page_id, html)."""
    first: dict = {}
    for p, html in rows:
        first.setdefault(html or "", []).append(p)
    out = []
    for p, html in rows:
        data = (html or "").encode()
        least = min((x for x in first[html or ""] if x is not None), default=None)
        again = least is not None and least != p
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", least if again else None))
    return out


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def hit_words(text, items, window=10):
    """Places of hit words and the items that occur; ``items``: (item_id, text)."""
    words, hit, found = item_words(text), set(), set()
    at: dict = {}
    for item, t in items:
        w = item_words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            at.setdefault(tuple(w[i : i + n]), set()).add(item)
    for n in {len(g) for g in at}:
        for i in range(len(words) - n + 1):
            if (g := tuple(words[i : i + n])) in at:
                hit.update(range(i, i + n))
                found |= at[g]
    return words, hit, found


def cleaned(text, items):
    """The text without its hit runs, or ... if over half of its words are hit."""
    words, hit, _ = hit_words(text, items)
    if not hit:
        return text
    if len(hit) > 0.5 * len(words):
        return ...
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]
    gone, i = [], 0
    while i < len(words):
        if i in hit:
            j = i
            while j + 1 in hit:
                j += 1
            gone.append((places[i][0], places[j][1]))
            i = j
        i += 1
    for a, b in reversed(gone):
        text = text[:a] + text[b:]
    return text


def permuted(s: str, key: str, kind: str, classes: tuple[str, ...], rounds: int = 8) -> str:
    """The Feistel network over the halves of a string."""
    half = len(s) // 2
    left, right = s[:half], s[half:]
    for r in range(1, rounds + 1):
        stream = bytes.fromhex(hashlib.sha256("|".join([key, kind, str(r), left]).encode()).hexdigest())
        moved = ""
        for i, c in enumerate(right):
            alphabet = next((a for a in classes if c in a), None)
            moved += c if alphabet is None else alphabet[(alphabet.index(c) + stream[i % 32]) % len(alphabet)]
        left, right = moved, left
    return left + right


def paired(x: int, y: int, a: int, b: int, key: str, *label: str, rounds: int = 4) -> tuple[int, int]:
    """The additive network over Z_a and Z_b."""
    draw = lambda r, other: int(hashlib.sha256("|".join([key, *label, str(r), str(other)]).encode()).hexdigest()[:12], 16)
    for r in range(1, rounds + 1):
        x = (x + draw(r, y)) % a
        y = (y + draw(r, x)) % b
    return x, y


def issued(s: str) -> bool:
    area, group, serial = (int(x) for x in s.split("-"))
    return 1 <= area <= 899 and area != 666 and group > 0 and serial > 0


def ssn(s: str, key: str) -> str:
    if not issued(s):
        return s
    areas = [n for n in range(1, 900) if n != 666]
    area, group, serial = (int(x) for x in s.split("-"))
    x, y = paired(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
    return f"{areas[x // 99]:03d}-{x % 99 + 1:02d}-{y + 1:04d}"


def luhn(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def card(m: str, key: str) -> str:
    cuts = [0, *(i + 1 for i, c in enumerate(m) if c in " -")]
    ends = [*(i for i, c in enumerate(m) if c in " -"), len(m)]
    spans = [(a, b) for a in cuts for b in ends if a < b]
    bare = lambda t: re.sub("[ -]", "", t)
    good = [(a, b) for a, b in spans if 13 <= len(bare(m[a:b])) <= 19 and luhn(bare(m[a:b])) == 0]
    if not good:
        return m
    a, b = min(good, key=lambda s: (-len(bare(m[s[0] : s[1]])), s[0]))
    body = permuted(bare(m[a:b])[:-1], key, "card", ("0123456789",))
    new = iter(body + str(-luhn(body + "0") % 10))
    return m[:a] + "".join(c if c in " -" else next(new) for c in m[a:b]) + m[b:]


def date(m: str, key: str) -> str:
    from datetime import date as day
    from datetime import datetime, timedelta

    layout = "%Y-%m-%d" if m[4] == "-" else "%d.%m.%Y" if m[2] == "." else "%m/%d/%Y"
    try:
        d = datetime.strptime(m, layout).date()
    except ValueError:
        return m
    for first, a, b in ((day(1830, 1, 1), 92, 397), (day(1930, 1, 1), 75, 487), (day(2030, 1, 1), 92, 397)):
        n = (d - first).days
        if 0 <= n < a * b:
            x, y = paired(n // b, n % b, a, b, key, "date", first.isoformat())
            return (first + timedelta(days=x * b + y)).strftime(layout)
    return m


def address(m: str, key: str) -> str:
    octets = m.split(".")
    if any(int(o) > 255 for o in octets):
        return m
    new = permuted("".join(f"{int(o):02x}" for o in octets), key, "ip", ("0123456789abcdef",))
    return ".".join(str(int(new[i : i + 2], 16)) for i in range(0, 8, 2))


def phone(m: str, key: str) -> str:
    found = re.match(r"\+(?:1|[2-9][0-9]{0,2}?)(?=[ .(-]|[0-9])", m)
    code = found.group() if found else ""
    return code + permuted(m[len(code) :], key, "phone", ("0123456789",))


def email(m: str, key: str) -> str:
    local = m.split("@")[0]
    return permuted(local, key, "email", ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) + m[len(local) :]


def ascii_classes(pattern: str) -> str:
    """``\\w`` and ``\\d`` written out as ASCII, in and outside of brackets."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\w", r"\d"):
            chars = "A-Za-z0-9_" if two == r"\w" else "0-9"
            out += chars if inside else f"[{chars}]"
            i += 2
            continue
        if two[0] == "\\":
            out += two
            i += 2
            continue
        inside = True if two[0] == "[" else False if two[0] == "]" else inside
        out += two[0]
        i += 1
    return out


def pseudonymised(text, key, pii):
    """Text with pseudonyms, and how many values of each kind changed; patterns are the operator's, all else is plain code."""
    import regex

    if text is None:
        return (None, *[0] * len(pii.KINDS))
    key = hashlib.sha256(key.encode()).hexdigest()
    kinds = {"email": email, "ip": address, "date": date, "ssn": ssn, "card": card, "phone": phone, "token": lambda m, k: permuted(m, k, "token", ("0123456789abcdef",))}
    counts = dict.fromkeys(pii.KINDS, 0)
    every = "|".join(f"(?P<{k}>{ascii_classes(p)})" for k, p in pii.PATTERNS.items())

    def new(m):
        kind = next(k for k, v in m.groupdict().items() if v is not None)
        done = kinds[kind](m.group(), key)
        counts[kind] += done != m.group()
        return done

    return (regex.sub(every, new, text), *(counts[k] for k in pii.KINDS))


def log_probabilities(net, classes):
    """One window through embedding, convolutions, ReLU, max pooling and softmax, layer by layer."""
    e = net.embedding[classes]
    features = []
    for f, bias in zip(net.filters, net.biases, strict=True):
        w = len(f)
        z = np.array([sum(e[i + k] @ f[k] for k in range(w)) for i in range(len(classes) - w + 1)])
        features.append(np.maximum(z + bias, 0).max(axis=0))
    logits = np.concatenate(features) @ net.out + net.out_bias
    return logits - logits.max() - np.log(np.exp(logits - logits.max()).sum())


def language(net, text):
    from poolgauge.llm import langid

    if text is None or not any(c.isalpha() for c in text):
        return "und", 1.0
    data, total = text.encode(), 0
    for at in range(0, len(data), langid.WINDOW):
        part = data[at : at + langid.WINDOW]
        classes = np.zeros(langid.WINDOW, dtype=np.int64)
        classes[: len(part)] = [langid.CLASSES[b] for b in part]
        total = total + log_probabilities(net, classes) * len(part)
    share = np.exp(total / len(data) - (total / len(data)).max())
    return net.languages[int(share.argmax())], float((share / share.sum()).max())

def repaired(rows):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of (conv_id, turn, role, text), by trying every edit."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        kept += [(turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return [_repaired(conv, sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for conv, kept in convs.items()]


def _repaired(conv, rows):
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.rstrip(WHITE)
        faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "g")
        seen.add((role, text))
    names = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, state, inserted):
        """(cost, audit, lines) of rows from i on, when ``state`` is the last initial said."""
        new = "a" if state == "u" else "u"
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            ways.append((cost + 2, "D" + audit, lines))
            if faults[i] in "tg":
                more = 5 * (faults[i] == "t")
                if role[:1] == new or (role[:1], state) == ("s", ""):
                    cost, audit, lines = best(i + 1, role[:1], 0)
                    ways.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                cost, audit, lines = best(i + 1, new, 0)
                ways.append((cost + more + 1, "R" + audit, (f"{names[new]}:{text}", *lines)))
        if inserted < 3:
            cost, audit, lines = best(i, new, inserted + 1)
            ways.append((cost + 5, "I" + audit, (f"{names[new]}:", *lines)))
        return min(ways, key=lambda w: w[:2], default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def aligned(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, hash) of (doc_id, text), from whole texts."""
    import sentencepiece

    from poolgauge.llm.bpe import _BYTE_OF

    tok = tokenizer()
    tok.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found, count = [], collections.Counter()
    for doc_id, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        of_a = [b"".join(_BYTE_OF[c] for c in tok.id_to_token(i)) for i in a]
        of_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            a = b = of_a = of_b = []
        ends_a, ends_b = (np.cumsum([len(x) for x in side], dtype=int).tolist() for side in (of_a, of_b))
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        links, j = [], 0
        for i, end in enumerate(ends_a):
            while ends_b[j] <= end - len(of_a[i]):
                j += 1
            k = j
            while k < len(b) and ends_b[k] - len(of_b[k]) < end:
                links.append((a[i], b[k]))
                k += 1
        count.update(set(links))
        found.append((doc_id, len(a), len(b), groups, links))
    most: dict = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(d, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), digest(groups)) for d, n_a, n_b, groups, links in found]
