"""Plain Python for the queries that SQL cannot tell: name -> function of the tables' rows that gives the query's rows."""

import hashlib
import re
import string
import unicodedata

from lexiloom.functions import normalizer, spell, text as X
from lexiloom.functions.special_tokens import FAMILIES
from lexiloom.plans.text import ABBREVIATED


def _digest(rows, made):
    out = []
    for r in rows:
        said = None if r["text"] is None else made(r["text"])
        out.append((r["doc_id"], None if said is None else len(said), None if said is None else hashlib.md5(said.encode()).hexdigest()))
    return {"columns": ["doc_id", "n_out", "out_md5"], "rows": out}


def naive_claims(text, steps):
    """Each rule in turn over the text, from every place, without guards; claims in a list of single places."""
    seen = " " + "".join(str(unicodedata.decimal(c)) if unicodedata.decimal(c, None) is not None else c for c in text) + " "
    found = []
    for r in steps:
        if not isinstance(r, normalizer.Rule):
            seen = r(seen)
            continue
        if r.kind in ("ratio", "score") and not any(n in seen.lower() for n in r.needs):
            continue
        at = 0
        if r.after is not None:
            first = r.after.search(seen)
            if not first:
                continue
            at = first.end()
        taken = []
        while at <= len(seen):
            m = r.pattern.match(seen, at)
            if m is None:
                at += 1
                continue
            taken += list(r.say(m))
            at = m.end() if m.end() > m.start() else at + 1
        places = list(seen)
        for a, b, said in taken:
            # blanks of earlier claims at the ends stay theirs
            sign = next((k for k in range(a, b) if not seen[k].isspace()), a)
            while any(seen[k] == normalizer.EDGE for k in range(a, sign)):
                a += 1
            while any(seen[k] == normalizer.EDGE for k in range(sign, b)):
                b -= 1
            for k in range(a, b):
                edge = k in (a, b - 1) if b - a > 2 else k == b - 1
                places[k] = normalizer.EDGE if edge or not said.strip() else normalizer.CLOSED
            found.append((max(a - 1, 0), min(b - 1, len(text)), r.kind, said))
        seen = "".join(places)
    return sorted(found)


def normalized(text, table=ABBREVIATED, strict=False):
    """The whole normalisation, one plain step after another."""
    said = {a: (b, s) for a, b, _, s in naive_claims(text, normalizer.steps(table, strict))}
    out, at = [], 0
    while at <= len(text):
        if at in said:
            out.append(said[at][1])
            stop = said.pop(at)[0]
            if stop > at:
                at = stop
                continue
        if at < len(text):
            out.append(text[at])
        at += 1
    return tidied("".join(out))


def end_marks(s):
    s = s.replace("\r\n", "\n").replace("\r", "\n")
    s = re.sub("(?<=[.,?!:;)\\]}'\"’”])\\s*\\n+\\s*", " ", s)
    s = re.sub(r"\s*\n+\s*", ". ", s).replace("phẩy", "phảy")
    return re.sub(r"\s+", " ", re.sub(r"(?<!\d)([.,])(?!\d)", r"\1 ", s)).strip()


def pause_signs(s):
    s = re.sub(r"\.{3,}", ".", s.replace("…", "."))
    for dash in "—–":
        s = re.sub(rf"(?<=\d)\s*{dash}\s*(?=\d)", "-", s).replace(dash, ",")
    s = re.sub("[()]", ", ", s)
    for sign in X.BLANKED:
        s = s.replace(sign, " ")
    return s.strip()


def emoji(s):
    return re.sub(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", X.EMOJI), "", s)


def tidied(s):
    s = re.sub(":+", ". ", pause_signs(emoji(end_marks(s))))
    s = re.sub(r"[^\w\s,.?!;-]", " ", s)
    s = re.sub(" +", " ", s)
    for mark in ".?,":
        s = re.sub(rf"[{mark}](?=\S)", f"{mark} ", s)
    words = re.sub(r"([.?!,])\s{2,}", r"\1 ", s).split()
    for first, second in normalizer.REDUNDANT:
        kept = words[:1]
        for before, word in zip(words, words[1:]):
            if (before, word) != (first, second):
                kept.append(word)
        words = kept
    return " ".join(words)


def native(s):
    s = emoji(end_marks(s))
    s = re.sub(rf"(\d+(?:[.,]\d+)?)\s*%\s*/\s*({'|'.join(X.PER_UNITS)})(?=[\s.,;:!?)\]}}]|$)", r"\1 phần trăm trên \2", s, flags=re.I)
    for sign, said in X.VERBATIM:
        s = re.sub(rf"(?:(?<=\s)|(?<=^)|(?<=[^\w])){re.escape(sign)}(?=[\s,.:;!?)\]}}\w]|$)", f" {said} ", s)
    s = pause_signs(s.strip())
    if "tỉ lệ" in s.lower():
        s = re.sub(r"\b(\d+):(\d+)\b", r"\1 \2", s)
    s = re.sub(":+", ". ", s.strip())
    s = re.sub(r"(\d)\s?[-–—]\s?(\d)", r"\1 đến \2", s)
    s = re.sub(r"(?<=[a-zA-ZÀ-ỹ])\s*-\s*(?=[a-zA-ZÀ-ỹ])", " ", s)
    s = re.sub(r"(?<=\s)-(?=\s)", " ", re.sub(r"(?<!\w)-(?!\w)", " ", s))
    s = re.sub(" +", " ", re.sub(r"[^\w\s,.?!;-]", " ", s))
    return re.sub(" +", " ", re.sub(r"\s*([.?,])\s*", r"\1 ", s)).strip()


def spoken_claims(rows):
    counts = {}
    for r in rows:
        for a, b, kind, _ in naive_claims(r["text"] or "", normalizer.steps(ABBREVIATED)):
            n, chars = counts.get((r["doc_id"], kind), (0, 0))
            counts[r["doc_id"], kind] = (n + 1, chars + b - a)
    return {"columns": ["doc_id", "kind", "n_chars", "n_claims"], "rows": [(*k, chars, n) for k, (n, chars) in counts.items()]}


def chunks_of(text, cap):
    """Paragraphs, sentences, words into chunks of at most ``cap``; a chunk that is only blank goes on."""
    if len(text) <= cap:
        return [text] if text else []
    pieces = []
    for p in re.split(r"(\n+)", text):
        for s in [p] if len(p) <= cap else re.split(r"([.?!;:]\s+)", p):
            pieces += [s] if len(s) <= cap else re.split(r"(\s+)", s)
    out = [""]
    for piece in pieces:
        if len(out[-1]) + len(piece) > cap and out[-1].strip():
            out.append("")
        out[-1] += piece
    return out if out[-1].strip() else out[:-1]


def text_chunks(rows):
    return {"columns": ["chunk", "doc_id", "n_chars", "text_md5"], "rows": [(k, r["doc_id"], len(c), hashlib.md5(c.encode()).hexdigest()) for r in rows for k, c in enumerate(chunks_of(r["text"] or "", 500))]}


def edits(r, h):
    """Substitutions, deletions, insertions read back from the whole table of costs."""
    cost = [[i + j if not i or not j else 0 for j in range(len(h) + 1)] for i in range(len(r) + 1)]
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (r[i - 1] != h[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, n = len(r), len(h), [0, 0, 0]
    while i or j:
        if i and j and r[i - 1] == h[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + 1:
            i, j, n[0] = i - 1, j - 1, n[0] + 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i, n[1] = i - 1, n[1] + 1
        else:
            j, n[2] = j - 1, n[2] + 1
    return n


def word_error_rate(rows):
    """Each turn against the next one, letters and blanks only."""
    by, clean = {}, lambda t: re.sub("[^a-z ]", "", t.lower())
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    out = []
    for turns in by.values():
        turns.sort(key=lambda r: r["turn"])
        for a, b in zip(turns, turns[1:]):
            r, h = clean(a["text"]), clean(b["text"])
            s, d, i = edits(r.split(), h.split())
            n = len(r.split(" "))
            out.append((a["conv_id"], d, i, float(f"{(s + d + i) / n:.6f}"), s, a["turn"], n))
    return {"columns": ["conv_id", "deletions", "insertions", "rate", "substitutions", "turn", "words"], "rows": out}


def english(text):
    for short, long in X.ABBREVIATIONS:
        text = re.sub(rf"\b{short}\b", long, text, flags=re.I | re.A)
    return spell.speak_en(text)


def cased(text):
    return finished(text.lower())


def finished(text):
    s = re.sub(r"\s+([.,;:!?])", r"\1", text)
    s = re.sub(r"\.[,;:]+", ".", re.sub(r"[,;:]+\.", ".", s))
    s = re.sub(r"\.{2,}", ".", re.sub(",{2,}", ",", s))
    s = re.sub(r"\s{2,}", " ", re.sub(r"([.,;:!?])(?=[a-zA-ZÀ-ỹ【])", r"\1 ", s)).strip()
    s = s[:1].upper() + s[1:]
    # a letter behind a sentence's end
    return re.sub(r"([.!?]\s+)([a-z])", lambda m: m[1] + m[2].upper(), s)


def doubled(text):
    return re.sub(r"(?<!,),(?!,)", ",,", re.sub(r"(?<!\.)\.(?!\.)", "..", text))


def special_tokens(rows):
    """Which characters a family covers, and the maximal runs of them."""
    out = []
    for r in rows:
        text, cover = r["text"] or "", {}
        for place, (kind, pattern) in enumerate(FAMILIES):
            for m in pattern.finditer(text):
                if kind != "expression" or re.search("[²³⁴⁰¹⁵⁶⁷⁸⁹√±∓×÷≠≈≡≤≥Δ∑∏=]", m[0]):
                    for k in range(*m.span()):
                        cover.setdefault(k, set()).add(place)
        for k in sorted(cover):
            if k - 1 in cover:
                continue
            stop = k
            kinds = set()
            while stop in cover:
                kinds |= cover[stop]
                stop += 1
            out.append((r["doc_id"], stop, "+".join(FAMILIES[p][0] for p in sorted(kinds)), k, text[k:stop]))
    return {"columns": ["doc_id", "end", "kind", "start", "token"], "rows": out}


def word_at(text, k):
    return 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")


def longest(text, entries):
    """At each place in turn, the longest entry that stands there as whole words; (key, said, cased)."""
    cased = {k: s for k, s, c in entries if c}
    plain = {k.lower(): s for k, s, c in entries if not c}
    sizes = sorted({len(k) for k in (*cased, *plain)}, reverse=True)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out, at = [], 0
    while at < len(text):
        for n in sizes if word_at(text, at - 1) != word_at(text, at) else ():
            if at + n <= len(text) and word_at(text, at + n - 1) != word_at(text, at + n):
                said = cased.get(text[at : at + n], plain.get(low[at : at + n]))
                if said is not None:
                    out.append(said)
                    at += n
                    break
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def phrase_entries():
    import duckdb

    keys = set()
    for (text,) in duckdb.sql("select text from '/root/testdata/sf0.001/benchmark.parquet'").fetchall():
        w = re.findall(r"\w+", text)
        keys |= {k for k in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))] if len(k) > 4 and len(w) > 1}
    return [(k, hashlib.md5(k.encode()).hexdigest()[:6], bool(re.match("[A-Z]", k))) for k in sorted(keys)]


def longest_replacement(rows):
    entries = phrase_entries()
    return _digest(rows, lambda t: longest(t, entries))


def spelled(word):
    return " ".join({**X.LETTERS, **X.DIGITS}[c] for c in word.upper())


def vietnamese_text(rows):
    words = [(k, s, False) for k, s, c in phrase_entries() if not c]
    learned = [(s, f"{s} x", False) for _, s, _ in words]

    def made(text):
        said = re.sub(r"\.{2,}\s*", ". ", re.sub(r"\s+", " ", normalized(text)))
        said = longest(longest(said, words), learned)
        first = re.search("[a-z]{4,}", text)
        own = [(first[0], first[0].upper(), False)] if first else []
        own += [(a, f"【{spelled(a)}】,", True) for a in dict.fromkeys(re.findall(r"\b[A-Z]{2,4}\b", text, re.A))]
        said = longest(said, own)
        said = longest(said, [(a, f"【{spelled(a)}】", True) for a in ("AI", "TTS", "URL")])
        return finished(said)

    return _digest(rows, made)


def moment_eigenvalues(rows):
    import numpy as np

    x = np.array([r["embedding"] for r in rows], float)
    return {"columns": ["k", "value"], "rows": [(k, round(float(v), 6)) for k, v in enumerate(np.linalg.eigvalsh(x.T @ x / len(x))[::-1])]}


def _cleaned(text):
    text = re.sub(r"\[.*?\]|<.*?>|\(.*?\)", "", text)
    return re.sub(r"\s+", " ", "".join(c for c in text if c == "'" or c not in string.punctuation)).strip().lower()


def _two_speakers(dialogue):
    parts = [p.strip() for p in re.split(r"\[S[1-9]\]", dialogue)]
    return [_cleaned(" ".join(parts[::2])), _cleaned(" ".join(parts[1::2]))]


def _cp_rows(rows):
    by = {(r["conv_id"], r["turn"]): r["text"] for r in rows}
    heard = lambda t: re.sub(r"\b([a-z])([a-z]{6})\b", r"\2\1 \1", re.sub(r"\b[a-z]{4}\b", "", t))
    marked = lambda a, b: f"[S1] (laughs) {a} [S2] <noise> {b}"
    for (conv, turn), r in sorted(by.items()):
        h = by.get((conv, turn + 1))
        if turn % 2 or h is None or len(r) + len(h) > 1500:
            continue
        truth = _two_speakers(marked(r, h))
        said = _two_speakers(marked(heard(r), heard(h)) if conv % 2 == 0 else marked(heard(h), heard(r)))
        words = lambda a, b: f"{a} {b}".split()
        straight, crossed = edits(words(*truth), words(*said)), edits(words(*truth), words(*said[::-1]))
        swapped = not sum(straight) < sum(crossed)
        n = len(re.sub(r"\s+", " ", f"[S1] {truth[0]} [S2] {truth[1]}").split(" ")) - 2
        yield conv, turn, swapped, n, crossed if swapped else straight


def cp_error_kinds(rows):
    return {"columns": ["conv_id", "deletions", "insertions", "substitutions", "swapped", "turn", "words"], "rows": [(c, d, i, s, w, t, n) for c, t, w, n, (s, d, i) in _cp_rows(rows)]}


def cp_error_totals(rows):
    own = list(_cp_rows(rows))
    s, d, i = (sum(k[j] for *_, k in own) for j in range(3))
    n = sum(r[3] for r in own)
    return {"columns": ["deletions", "insertions", "rate", "substitutions", "words"], "rows": [(d, i, round((s + d + i) / n * 100, 2), s, n)]}


def segments(text):
    """Characters and enclosed parts one after another, each with its language."""
    parts = re.findall(r"[<[].*?[>\]]|.", text.replace("\n", ""))
    closed = lambda p, a, b: len(p) > 1 and p[0] == a and p[-1] == b
    runs = []
    for p in parts:
        lang = "zh" if closed(p, "<", ">") or "一" <= p <= "龥" else "en" if re.fullmatch("[A-Za-z]", p) else "other"
        if runs and (lang == "other" or runs[-1][1] in ("other", lang)):
            runs[-1] = (runs[-1][0] + p, runs[-1][1] if lang == "other" else lang)
        else:
            runs.append((p, lang))
    out = []
    for run, lang in runs:
        for p in filter(None, re.split(r"([<[].*?[>\]])", run)):
            out.append((p, "pinyin" if closed(p, "<", ">") else "tag" if closed(p, "[", "]") else lang))
    return out


def tokens(text):
    out = []
    for part, lang in segments(text):
        if lang == "pinyin":
            inner = part.strip("<>")
            if inner[:-1].isalpha() and inner[-1:] in tuple("12345"):
                initial = next((i for i in ("zh", "ch", "sh", *"bpmfdtnlgkhjqxrzcsyw") if inner.startswith(i)), "")
                out += ([f"{initial}0"] if initial else []) + [inner[len(initial) :]]
        elif lang == "tag":
            out.append(part)
        elif lang != "other":
            out += list(part)
    return out


def dispatched_tokens(rows):
    out = []
    for r in rows:
        t = r["text"]
        for a, b in [(" the ", " 我们，"), (" of ", "<zhong1>"), (" und ", " [laugh] "), (" der ", "<ai4>是"), (" de ", " [S1] "), (" la ", " <x "), (" y ", "<a]")]:
            t = t.replace(a, b)
        t = re.sub(r"\s*(\[S[12]\])\s*", r"\1", t)
        for a, b in [*X.WIDE, *((d, "…") for d in X.DOTS)]:
            t = t.replace(a, b)
        own = tokens(t)
        out.append((r["doc_id"], len(own), hashlib.md5("|".join(own).encode()).hexdigest()))
    return {"columns": ["doc_id", "n_tokens", "tokens_md5"], "rows": out}


def cut_silence(wave, rate, trail_ms, longest_ms, keep_ms, edge_ms, db, step_ms):
    """Sample by sample: which are within reach of a loud step."""
    step = max(1, rate * step_ms // 1000)
    steps = [wave[k : k + step] for k in range(0, len(wave), step)]
    loud = [sum(x * x for x in s) / len(s) > 10 ** (db / 10) for s in steps]
    out = []
    for k, x in enumerate(wave):
        at = k // step
        before = max((j for j in range(at + 1) if loud[j]), default=None)
        after = min((j for j in range(at, len(loud)) if loud[j]), default=None)
        if before is None and after is None:
            continue
        if before is None:
            stays = k >= after * step - rate * edge_ms // 1000
        elif after is None:
            stays = k < (before + 1) * step + rate * edge_ms // 1000
        elif (after - before - 1) * step < rate * longest_ms // 1000:
            stays = True
        else:
            stays = k < (before + 1) * step + rate * keep_ms // 1000 or k >= after * step - rate * keep_ms // 1000
        if stays:
            out.append(x)
    return out + [0.0] * (rate * trail_ms // 1000)


def silence_cut(rows):
    out = []
    for r in rows:
        wave = [x if (i // (r["vec_id"] % 9 + 2)) % 2 == 0 else x / 1000 for i, x in enumerate(map(float, r["embedding"]))]
        w = cut_silence(wave, 64, 62, 125, 31, 16, -40.0, 16)
        out.append((len(w), round(sum(w), 6), r["vec_id"]))
    return {"columns": ["n", "total", "vec_id"], "rows": out}


TWINS = {
    "normalize_full": ("documents", lambda rows: _digest(rows, normalized)),
    "native_normalize": ("documents", lambda rows: _digest(rows, native)),
    "spoken_claims": ("documents", spoken_claims),
    "special_tokens": ("documents", special_tokens),
    "longest_replacement": ("documents", longest_replacement),
    "vietnamese_text": ("documents", vietnamese_text),
    "moment_eigenvalues": ("embeddings", moment_eigenvalues),
    "cp_error_kinds": ("conversations", cp_error_kinds),
    "cp_error_totals": ("conversations", cp_error_totals),
    "dispatched_tokens": ("documents", dispatched_tokens),
    "silence_cut": ("embeddings", silence_cut),
    "text_chunks": ("documents", text_chunks),
    "word_error_rate": ("conversations", word_error_rate),
    "normalize_english": ("documents", lambda rows: _digest([r for r in rows if r["lang"] == "en"], english)),
    "sentence_case": ("documents", lambda rows: _digest(rows, cased)),
    "double_punctuation": ("documents", lambda rows: _digest(rows, doubled)),
}
