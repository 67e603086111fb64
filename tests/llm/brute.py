"""Plain versions of operators, for small inputs."""

import hashlib
import re
import string
from itertools import combinations

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def jaccard_components(rows):
    """{doc_id: (n_shingles, component_id)} for (doc_id, text) rows of distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    seen = set()
    for ids in at.values():
        for a, b in combinations(ids, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def sentence_units(text, window=9):
    """[(start, end of text up to the next unit, words)] of a text's sentences, long ones cut at the words of lowest key."""
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    low = [m.group().translate(_LOWER) for m in found]
    keys = ["" if re.search(r"[.!?][\"')\]]?$", w) else hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()[:16] for w in low]
    ends = {k for k, key in enumerate(keys) if not key}
    for i in range(len(keys) - window + 1):
        part = keys[i : i + window]
        ends.update(i + k for k, key in enumerate(part) if key == min(part))
    out = []
    for k, m in enumerate(found):
        if k == 0 or k - 1 in ends:
            out.append([m.start(), None, []])
        out[-1][2].append(low[k])
    for a, b in zip(out, [*out[1:], [len(text)]], strict=True):
        a[1] = b[0]
    return out


def span_dedup(rows, words=24):
    """{doc_id: (text, sentences removed)} for (doc_id, text) rows of distinct ids."""
    units = {i: sentence_units(t or "") for i, t in rows}
    places = {}
    for i, u in units.items():
        for a in range(len(u)):
            run = []
            for b in range(a, len(u)):
                run += u[b][2]
                if len(run) >= words:
                    places.setdefault(tuple(run), set()).add((i, a, b))
                    break
    gone = {i: set() for i in units}
    for found in places.values():
        for i, a, b in sorted(found)[1:]:
            gone[i].update(range(a, b + 1))
    out = {}
    for i, t in rows:
        u = units[i]
        if gone[i]:
            out[i] = (t[: u[0][0]] + "".join(t[x[0] : x[1]] for k, x in enumerate(u) if k not in gone[i])).rstrip(), len(gone[i])
        else:
            out[i] = (t, 0)
    return out


def repeated_words(texts, size):
    """{doc_id: for each word whether it lies in a sequence of ``size`` words that another text has too}."""
    found = {i: [w for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(_LOWER))] for i, t in texts}
    homes = {}
    for i, w in found.items():
        for k in range(len(w) - size + 1):
            homes.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = {i: [False] * len(w) for i, w in found.items()}
    for i, w in found.items():
        for k in range(len(w) - size + 1):
            if len(homes[tuple(w[k : k + size])]) > 1:
                out[i][k : k + size] = [True] * size
    return out


def demultiplex(stream):
    """(payload, timestamps, random-access units) of a transport stream of one program, packet by packet, as the standard has it."""

    def checksum(data):
        rest = int.from_bytes(b"\xff\xff\xff\xff", "big")
        for byte in data:
            for bit in range(7, -1, -1):
                top = (rest >> 31) ^ (byte >> bit & 1)
                rest = (rest << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
        return rest

    def section(packet):
        body = packet[5 + packet[4] :] if packet[3] & 0x20 == 0 else None
        size = 3 + ((body[1] & 0x0F) << 8 | body[2])
        assert checksum(body[:size]) == 0
        return body[8 : size - 4]

    number = lambda two: (two[0] & 0x1F) << 8 | two[1]
    tables, wanted, counters, units = None, None, {}, []
    for at in range(0, len(stream), 188):
        packet = stream[at : at + 188]
        assert packet[0] == 0x47 and len(packet) == 188
        pid, start, has_extra, has_data = number(packet[1:3]), packet[1] & 0x40, packet[3] & 0x20, packet[3] & 0x10
        assert has_data and (pid not in counters or packet[3] & 15 == (counters[pid] + 1) % 16)
        counters[pid] = packet[3] & 15
        if pid == 0:
            found = section(packet)
            tables = next(number(found[i + 2 : i + 4]) for i in range(0, len(found), 4) if found[i : i + 2] != b"\0\0")
        elif pid == tables:
            found = section(packet)
            wanted = number(found[4 + number(found[2:4]) % 4096 :][1:3])
        elif pid == wanted:
            data = packet[5 + packet[4] :] if has_extra else packet[4:]
            if start:
                units.append([bytearray(), bool(has_extra and packet[4] and packet[5] & 0x40)])
            units[-1][0] += data
    payload, stamps = b"", []
    for data, _ in units:
        assert data[:3] == b"\0\0\1" and data[7] & 0x80
        size = data[4] << 8 | data[5]
        assert size in (0, len(data) - 6)
        a, b, c, d, e = data[9:14]
        assert a & 1 and c & 1 and e & 1
        stamps.append((a >> 1 & 7) << 30 | b << 22 | (c >> 1) << 15 | d << 7 | e >> 1)
        payload += bytes(data[9 + data[8] :])
    return payload, stamps, [r for _, r in units]
