"""op2, op9, op10, op7 and the pipeline: brute force, pinned cases, awkward rows."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from corpusloom.llm import codes, decontaminate, html, packing, substrings, urls
from corpusloom.llm.common import scratch
import pytest
from pyspark.sql import functions as F

ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."), (2, "one two three four five six seven eight nine ten one two three four five six"), (3, "too short"), (4, None)]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ITEMS[0][1].split() + ITEMS[1][1].split() + ["noise"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(60)]
    rows += [(100, "x " * 20 + ITEMS[0][1].upper() + " y" * 5), (101, "pre " + ITEMS[1][1] + "%%% post"), (102, ITEMS[1][1].replace("ten one", "ten")), (103, None), (104, ""), (105, "too short"), (106, "w " * 50_000 + ITEMS[0][1]), (100, "x " * 20 + ITEMS[0][1].upper() + " y" * 5), (None, ITEMS[0][1])]

    def bag(tokens):
        return [tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4)]

    truth = {}
    for doc, text in rows:
        tokens = re.findall(r"\w+", (text or "").lower())
        for item, source in ITEMS:
            target = bag(re.findall(r"\w+", (source or "").lower()))
            for s in range(len(tokens) - len(target) - 3) if target else ():
                window = bag(tokens[s : s + len(target) + 4])
                shared = sum(min(window.count(x), target.count(x)) for x in set(window))
                if shared / (2 * len(target) - shared) >= 0.8:
                    truth[doc, item] = max(truth.get((doc, item), 0), round(shared / (2 * len(target) - shared), 6))
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, item_id int, h int, _id int")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, h string")
    got = {(None if r.none else r.id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == truth and {(100, 1), (101, 2), (106, 1), (None, 1)} <= set(got)
    clean = decontaminate.drop_leaks(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum((d, i) not in truth for d, _ in rows for i in [0]) - sum(1 for d, _ in rows if any((d, i) in truth for i, _ in ITEMS))
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_texts_shorter_than_the_item(spark):
    words = [f"word{k}" for k in range(54)]
    texts = {1: words[:50], 2: words[4:], 3: words[:44], 4: words[:43], 5: words[1:20] + words[21:], 6: words[:-1], 7: words, 8: ["else"] + words[:49]}
    bag = lambda tokens: {tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4)}
    truth = {i: round(len(bag(t) & bag(words)) / len(bag(t) | bag(words)), 6) for i, t in texts.items()}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.id: (r.similarity, r.first_word, r.n_words) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {i: (s, 0, len(texts[i])) for i, s in truth.items() if s >= 0.8} and set(got) == {1, 2, 3, 5, 6, 7, 8}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()} == {4}


def test_leaks_near_the_threshold_are_found(spark):
    rng = random.Random(11)
    texts = {i: [f"w{rng.randrange(10**9)}" for _ in range(50)] for i in range(400)}
    edited = {i: t[:20] + ["else"] + t[21:] for i, t in texts.items()}  # 41 of 46 shingles, 41 / 51 in all
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in rows.items()], f"{key} long, text string")
    got = {(r.id, r.item_id) for r in decontaminate.find_leaks(frame(edited, "doc_id"), frame(texts, "item_id")).collect()}
    assert got == {(i, i) for i in texts}


def test_the_exact_way_equals_brute_force_and_the_radius_misses_few(spark):
    """Items of 20 to 110 shingles, copies edited down to the threshold."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(400)}"
    items = {i: [word() for _ in range(rng.randint(24, 114))] for i in range(120)}
    rows = {}
    for i, t in items.items():
        for k in range(4):
            copy = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 35))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["else"], [copy[at], "more"]])
            rows[4 * i + k] = [word() for _ in range(rng.randint(0, 20))] + copy + [word() for _ in range(rng.randint(0, 20))]
    bag = lambda tokens: Counter(tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4))
    truth = {}
    for doc, tokens in rows.items():
        for item in (doc // 4, (doc // 4 + 1) % 120):
            target = bag(items[item])
            size = sum(target.values())
            for start in range(max(1, len(tokens) - 4 - size + 1)):
                window = bag(tokens[start : start + size + 4])
                shared = (window & target).total()
                if shared >= 0.8 * (size + window.total() - shared) - 1e-9:
                    truth[doc, item] = max(truth.get((doc, item), 0), round(shared / (size + window.total() - shared), 6))
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in rows.items()], f"{key} long, text string")
    found = lambda radius: {(r.id, r.item_id): r.similarity for r in decontaminate.find_leaks(frame(rows, "doc_id"), frame(items, "item_id"), radius=radius).collect()}
    assert found(None) == truth and 200 < len(truth) < 480
    near = found(decontaminate.RADIUS)
    assert near.items() <= truth.items() and len(near) >= 0.99 * len(truth)


def test_index_finds_everything_within_the_radius():
    rng = random.Random(3)
    near = decontaminate.nearby(decontaminate.RADIUS // decontaminate.BLOCKS)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        blocks = lambda x: [(x >> k * decontaminate.BLOCK_BITS) & ((1 << decontaminate.BLOCK_BITS) - 1) for k in range(decontaminate.BLOCKS)]
        assert any(x ^ y in near for x, y in zip(blocks(a), blocks(b)))


def word_number(word):
    return int(substrings.words_of(np.frombuffer(word.encode("utf-32-le"), "<u4"))[2][0])


def brute_repeats(rows, min_run):
    """Text after text in order of doc_id: lines of five words or more seen before are dropped; each line's words are cut before local minima, units
    seen before are marked, and long runs of them dropped."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        marked, at = [], 0
        for line in text.split("\n"):
            found = list(re.finditer(r"\w+", line))
            words = [m.group().lower() for m in found]
            h, n = [word_number(w) for w in words], len(words)
            cuts = [i for i in range(4, n - 3) if h[i] < min(h[max(0, i - 3) : i]) and h[i] <= min(h[i + 1 : i + 4])]
            whole = " ".join(words)
            gone = 5 <= n and whole in seen and (n < min_run or not cuts)
            for i, j in zip([0, *cuts], [*cuts, n]):
                if i < j:
                    key = " ".join(words[i:j])
                    marked += [(at + m.start(), at + m.end(), key in seen, gone) for m in found[i:j]]
                    seen.add(key)
            if 5 <= n < min_run:
                seen.add(whole)
            at += len(line) + 1
        kept, run = [], []
        for word in [*marked, (0, 0, False, False)]:
            if word[2]:
                run.append(word)
                continue
            if len(run) < min_run:
                kept += run
            kept, run = [*kept, word], []
        out[doc] = [text[a:b] for a, b, _, gone in kept[:-1] if not gone]
    return out


def test_runs_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(300)]
    passages = [[rng.choice(words) for _ in range(rng.randint(20, 80))] for _ in range(8)]
    short = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(10)]
    rows = []
    for i in range(80):
        parts = [rng.choices(words, k=rng.randint(0, 30)) for _ in range(4)] + rng.sample(passages, 2)
        rng.shuffle(parts)
        flat = [w.title() if rng.random() < 0.2 else w + rng.choice(["", "", ".", ","]) for p in parts for w in p]
        cut = rng.randrange(len(flat))
        rows.append((i, " ".join(flat[:cut]) + "\n" + rng.choice(short) + "\n" + " ".join(flat[cut:])))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    out = substrings.remove_repeats(docs, min_run=12).collect()
    truth = brute_repeats(rows, 12)
    assert {r.doc_id: re.findall(r"\w+", r.text) for r in out} == truth and sum(len(r.removed) for r in out) > 60
    for r in out:
        original, edges = dict(rows)[r.doc_id], [0, *(x for s in r.removed for x in (s.start, s.stop))]
        assert all(0 <= s.start < s.stop <= len(original) for s in r.removed)
        assert r.text == "".join(original[a:b] for a, b in zip(edges[::2], [*edges[1::2], len(original)]))


def test_spliced_passages_and_awkward_rows(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(14)) + "."
    passage = " ".join(sentence() for _ in range(4))
    rows = [(1, "Start here. " + passage + " End of one."), (2, "Other start, long enough, in the middle " + passage + " end of two."), (3, None), (4, ""), (None, passage), (5, "short line"), (6, "short line"), (7, "x\n" + passage + "\n" + "z" * 600_000 + "\n" + passage), (5, "short line")]
    docs = spark.createDataFrame([(*r, 9, "kept") for r in rows], "doc_id long, text string, h int, removed string")
    out = substrings.remove_repeats(docs)
    assert out.columns == [*docs.columns, "removed_"] and {r.removed for r in out.collect()} == {"kept"}
    texts = {r.doc_id: r.text for r in out.collect()}
    assert passage in texts[1] and texts[2].startswith("Other start") and texts[2].endswith("end of two.")
    assert len(set(passage.split()) & set(texts[2].split())) < 12
    assert texts[3] is None and texts[4] == "" and texts[5] == texts[6] == "short line"
    # A passage that is a line of its own has ends unlike those of one within a line; the second such line goes whole.
    assert texts[7].startswith("x\n") and texts[7].endswith("\n" + "z" * 600_000) and len(texts[7].split()) < 2 + 0.3 * len(passage.split())
    assert texts[None] == "" and out.count() == len(rows)
    empty = substrings.remove_repeats(docs.limit(0), spans_col=None)
    assert empty.count() == 0 and empty.columns == docs.columns


def test_common_phrases_and_short_lines_stay(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    line, phrase = words(4), words(15)
    rows = [(i, f"{words(30)}\n{line}\n{words(20)} {phrase} {words(20)}") for i in range(6)]
    out = {r.doc_id: r.text for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == dict(rows)


def test_repeated_lines_of_any_length_go(spark):
    rng = random.Random(10)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    lines = [words(n) for n in range(5, 61)]
    rows, clean = [], []
    for i in range(5):
        own = [words(rng.randint(6, 50)) for _ in range(len(lines) + 1)]
        clean.append("\n".join(own))
        rows.append((i, "\n".join(x for pair in zip(own, lines) for x in (pair[0], pair[1].upper() + "!")) + "\n" + own[-1]))
    out = {r.doc_id: r.text for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: rows[0][1], **dict(enumerate(clean[1:], 1))}


def test_groups_of_lines_change_no_unit():
    rng = random.Random(11)
    texts = ["\n".join(" ".join("".join(rng.choices("abc", k=3)) for _ in range(rng.randint(0, 40))) for _ in range(60)) for _ in range(3)]

    def found(size):
        out, read = Counter(), Counter()
        for group in codes.groups(texts, size, at_lines=True):
            part = substrings.units(*group)
            for x in part.itertuples():
                out[x.row, x.kind, x.word + read[x.row], x.words, x.d1, x.d2] += 1
            for row in set(part.row):
                read[row] += int((part.word + part.words)[part.row == row].max())
        return out

    assert found(10**6) == found(700) and sum(found(700).values()) > 200


def test_rules(spark):
    rows = [(1, "http://Shop.EXAMPLE.org/es/1?x"), (2, "https://example.org/en/17"), (3, "ftp://a.org"), (4, "https://notexample.com/fr/x"), (5, "https://x.com/de/"), (6, None), (7, "no scheme"), (8, "https://b.net/en/1#frag"), (8, "https://b.net/en/1#frag"), (9, "http://example.org/e"), (10, "x://h.com/" + "a/" * 5000)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(i, u, "c") for i, u in rows], "page_id long, url string, host string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("shop.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.org/en/1", "block") and (got[3].host, got[3].path, got[3].rule) == ("a.org", "", None)
    assert got[4].rule == "com/fr/" and got[5].rule == "com/de/" and (got[6].host, got[6].path) == ("", "") == (got[7].host, got[7].path)
    assert got[9].rule == "org/" and got[8].verdict in {"allow", "block"} and len(got) == 10
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_of_equal_length(spark):
    """Of two fitting rules of the same length the first by verdict, host and path wins; a longer one always does."""
    rules = (("block", "b.org", "/x"), ("allow", "a.b.org", ""), ("block", "org", "/xyz"), ("allow", "org", "/xyzw"))
    page = lambda url: urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), rules).first()
    assert (page("s://a.b.org/xy").rule, page("s://a.b.org/xy").verdict) == ("a.b.org", "allow")
    assert page("s://a.b.org/xyz").rule == "a.b.org" and page("s://b.org/xyz").rule == "b.org/x" and page("s://b.org/xyzw").rule == "org/xyzw"


def naive_tree(rows, z):
    """Paths of one host level by level, node by node: (host, segments) to template."""
    now = {(h, s): ("", s) for h, s, _ in rows}
    depth = max((len(s) for _, s, _ in rows), default=0)
    label, pages = defaultdict(list), Counter()
    for h, s, x in rows:
        label[h, s] += [] if x is None else [x]
        pages[h, s] += 1
    for level in range(depth):
        child, here = defaultdict(list), Counter()
        for (h, s), (prefix, _) in now.items():
            name = s[level] if level < len(s) else ""
            child[h, prefix, name] += label[h, s]
            here[h, prefix, name] += pages[h, s]
        parent, total, single = defaultdict(list), Counter(), Counter()
        for (h, prefix, name), xs in child.items():
            parent[h, prefix] += xs
            total[h, prefix] += here[h, prefix, name]
            single[h, prefix] += here[h, prefix, name] == 1
        for (h, s), (prefix, _) in list(now.items()):
            name = s[level] if level < len(s) else ""
            xs, all_, k, n = child[h, prefix, name], parent[h, prefix], single[h, prefix], total[h, prefix]
            slugs = (k + z * z / 2 - z * math.sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z) >= urls.SINGLES
            if name not in ("", "*"):
                p = (sum(all_) + 1) / (len(all_) + 2)
                if here[h, prefix, name] == 1 and slugs or xs and abs(sum(xs) / len(xs) - p) <= z * math.sqrt(p * (1 - p) / len(xs)):
                    name = "*"
            now[h, s] = (prefix + "/" + name if name else prefix, s)
    return {key: prefix or "/" for key, (prefix, _) in now.items()}


def test_tree_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(1500):
        path = tuple(rng.choice(["a", "b", "c", "*"]) for _ in range(rng.randint(0, 4)))
        bad = 0.9 if path[:1] == ("a",) else 0.5 if path[:2] == ("b", "c") else 0.1
        rows.append((rng.choice("gh"), path, None if rng.random() < 0.3 else int(rng.random() < bad)))
    for i in range(60):  # slugs of one page each, labelled and not, and a lone deep path
        rows.append(("s", ("post", f"slug-{'x' * i}", *(["more"] if i % 3 else [])), None if i % 2 else int(i % 5 == 0)))
    rows += [("d", tuple("abcdefghij"), 1), ("e", tuple("abcdefghij"), None), ("d", tuple("abcdefgxyz"), 1)]
    frame = spark.createDataFrame([(h, list(s), x) for h, s, x in rows], "host string, raw_segments array<string>, label int")
    tree = urls.template_tree(frame)
    got = {(r.host, tuple(r.raw_segments)): r.template for r in tree.collect()}
    truth = naive_tree(rows, urls.Z)
    assert got == truth and len(set(got.values())) > 5
    bad, n = defaultdict(int), defaultdict(int)
    for h, s, x in rows:
        for key in ((h, truth[h, s]), truth[h, s], ""):
            bad[key] += x or 0
            n[key] += x is not None
    for r in urls.template_purity(tree).collect():
        prior = (bad[r.template] + 4 * bad[""] / n[""]) / (n[r.template] + 4)
        assert abs(r.bad_share - (bad[r.host, r.template] + 4 * prior) / (n[r.host, r.template] + 4)) < 1e-9


def test_deep_and_long_paths_are_read_whole(spark):
    long = "long" * 200
    rows = [(i, f"s://e.org/{'a/' * 9}{long}/{'x' if i % 2 else 'y'}") for i in range(4)]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=()).collect()
    assert {r.template for r in out} == {f"{'/a' * 9}/{long}/x", f"{'/a' * 9}/{long}/y"}


def test_purity_tells_labels_that_it_was_not_learned_from(spark):
    """Sections of many hosts are bad or good with some noise; labels of a fifth of the pages are held out."""
    rng = random.Random(6)
    rows, held = [], []
    for h in range(30):
        sections = {f"sec{chr(97 + k)}": rng.random() < 0.4 for k in range(5)}
        for _ in range(200):
            name = rng.choice(list(sections))
            label = int(sections[name] != (rng.random() < 0.05))
            path = [name, "".join(rng.choices("abcdefgh", k=12))]
            hidden = rng.random() < 0.2
            rows.append((f"h{h}", path, None if hidden else label))
            if hidden:
                held.append((f"h{h}", tuple(path), int(sections[name])))
    rated = urls.template_purity(urls.template_tree(spark.createDataFrame(rows, "host string, raw_segments array<string>, label int")))
    share = {(r.host, tuple(r.raw_segments)): r.bad_share for r in rated.collect()}
    assert sum((share[h, p] >= urls.REJECT) == bool(x) for h, p, x in held) / len(held) > 0.97 and len(held) > 1000


def test_tree_rejects_by_purity(spark):
    rows = [("h", ["bad", "*"], 1)] * 30 + [("h", ["good", "*"], 0)] * 30 + [("h", ["bad", "*"], None)] * 5 + [("g", ["bad", "*"], None)] * 3
    tree = urls.template_tree(spark.createDataFrame(rows, "host string, raw_segments array<string>, label int"))
    share = {(r.host, r.template): r.bad_share for r in urls.template_purity(tree).collect()}
    assert share["h", "/bad/*"] > 0.9 and share["h", "/good/*"] < 0.1 and share["g", "/bad/*"] > 0.5
    alike = [("h", ["a", "*"], i % 2) for i in range(40)] + [("h", ["b", "*"], i % 2) for i in range(40)]
    merged = urls.template_tree(spark.createDataFrame(alike, "host string, raw_segments array<string>, label int"))
    assert {r.template for r in merged.collect()} == {"/*/*"}


def test_html():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><div class='cookie-notice'>ok?</div><article><h1>Head &amp; more</h1><p>one <b>two\n three</b><p>x<br>y<div id=comments>no</div><form>f</form><script>var a='</p>';</script></article><aside>side</aside><footer>foot"
    assert html.main_text(page) == "Head & more\none two three\nx y"
    assert html.main_text(None) == html.main_text("") == "" and html.main_text("a < b &lt; c") == "a < b < c"
    assert html.main_text("<div>" * 3000 + "deep") == "deep" and html.main_text("<p>x<!-- open") == "x"


def test_hostile_pages_take_linear_time():
    began = time.time()
    for x in ("<main>" * 20_000 + "x", "<a " * 20_000, "<a b=\"'" * 20_000, "</b>" * 50_000, "<b>" * 20_000 + "<p>x" * 10_000, "<ul><li><ul>" + "<b>" * 10_000 + "<li></li>" * 10_000, "<" * 50_000, "<!--" * 50_000, "<div>" * 20_000 + "x"):
        html.main_text(x)
        html.elements(x)
    assert time.time() - began < 30


def site(host, i, rng, menus):
    """A page without article, main or telling names: a menu and a line of the day, each one of many, the page's own text, a tail."""
    own = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12)) for _ in range(4)]
    menu, day = rng.choice(menus), rng.choice(menus)
    blocks = "".join(f"<li>{w}</li>" for w in menu.split())
    source = f"<html><body><div class='top'><ul>{blocks}</ul></div><div class='x'>{day}</div><section><h2>{own[0]}</h2><p>{own[1]}</p><p>{own[2]}</p><div>{own[3]}</div></section><div class='end'>{host} {2000 + i} all rights</div></body></html>"
    return (i, f"http://{host}/p{i}", source), "\n".join(own)


def brute_templates(rows):
    """What recurs on a host, page by page: numbers as host_templates() gives them."""
    pages = defaultdict(dict)
    for host, source in rows:
        content, found = html.elements(source, host)
        pages[host][content] = found
    held, fills = defaultdict(set), defaultdict(set)
    for host, all_ in pages.items():
        for content, found in all_.items():
            for slot, subtree, alone, inside in found:
                held[host, slot, subtree].add((content, inside))
                if alone:
                    fills[slot].add((host, content, subtree))
    out = defaultdict(set)
    for (host, slot, subtree), where in held.items():
        k, n, z = len({c for c, _ in where}), len(pages[host]), html.Z
        low = (k + z * z / 2 - z * math.sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z)
        if k > 1 and low >= (html.INSIDE if all(i for _, i in where) else html.OUTSIDE):
            out[host].add(subtree)
    for slot, instances in fills.items():
        anywhere = Counter(s for _, _, s in instances)
        prior = sum(anywhere[s] > 1 for _, _, s in instances) / len(instances)
        for host in {h for h, _, _ in instances}:
            own = Counter(s for h, _, s in instances if h == host)
            if (sum(v for v in own.values() if v > 1) + html.SMOOTHING * prior) / (own.total() + html.SMOOTHING) >= html.SLOT_OUTSIDE:
                out[host].add(slot)
    return {host: frozenset(v) for host, v in out.items()}


def test_templates_equal_brute_force_on_pages_without_telling_names(spark):
    rng = random.Random(3)
    menus = [" ".join("".join(rng.choices("uvwxyz", k=4)) for _ in range(6)) for _ in range(9)]
    made = [site(host, i, rng, menus) for host, n in (("a.x", 40), ("b.x", 12), ("c.x", 1)) for i in range(1000 * ord(host[0]), 1000 * ord(host[0]) + n)]
    pages = spark.createDataFrame([r for r, _ in made], "page_id long, url string, html string").repartition(5)
    host = lambda r: r[1].split("/")[2]
    got = {r.host: frozenset(r.templates) for r in html.host_templates(pages.selectExpr("split(url, '/')[2] AS host", "html")).collect()}
    assert got == brute_templates([(host(r), r[2]) for r, _ in made])
    out = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert out == {r[0]: own for r, own in made}


def test_host_templates(spark):
    page = lambda host, i: (i, f"http://{host}/p{i}", f"<div><div>site menu of {host}, {i} pages</div><div>own text {'abcdefghijklmnop'[i % 16]}</div><p>shared tail</p></div>")
    rows = [page("a.x", i) for i in range(8)] + [page("b.x", i) for i in range(100, 102)] + [page("c.x", 7)] + [(500, None, None), (501, "http://a.x/", "")]
    frame = spark.createDataFrame([(*r, 1) for r in [*rows, rows[0]]], "page_id long, url string, html string, text int")
    out = {r.page_id: r for r in html.extract(frame).collect()}
    assert out[3].text == "own text d" and out[3].n_chars == 10 and out[100].text == "own text e" and out[500].text == out[501].text == ""
    assert html.extract(frame).count() == len(rows) + 1
    # What one page alone holds is its content.
    alone = html.extract(spark.createDataFrame([page("c.x", 7)], "page_id long, url string, html string")).first()
    assert alone.text == "site menu of c.x, 7 pages\nown text h\nshared tail"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    names = "zero one two three four five six seven".split()
    article = lambda i: f"<article><h1>Head {names[i]}</h1><p>story {names[i]}</p></article>"
    plain = lambda i: f"<div><div>menu</div><p>words of {names[i]}</p></div>"
    rows = [(i, f"http://a.x/1?utm_source={i}", f"<a href='?utm_source={i}'>{i}</a>" + article(1)) for i in range(12)] + [(12 + i, f"http://a.x/{i}", article(i)) for i in (2, 3)]
    rows += [(100 + i, "http://b.x/1", plain(1)) for i in range(20)] + [(120 + i, f"http://b.x/{i}", plain(i)) for i in range(2, 8)]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {out[i] for i in range(12)} == {"Head one\nstory one"} and out[14] == "Head two\nstory two"
    assert {out[i] for i in range(100, 120)} == {"words of one"} and out[122] == "words of two"


def test_main_keeps_its_own_text():
    assert html.main_text("<p>out</p><main><h1>Head</h1><p>lead</p><article>one</article><article>two</article></main>") == "Head\nlead\none\ntwo"


def test_pipeline(spark):
    data = "/root/testdata/sf0.001"
    docs, sizes = spark.read.parquet(f"{data}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch(stage(spark, docs, data), "stage")
        sizes.append(docs.count())
        assert docs.columns == columns, name
    assert 200 > sizes[0] > sizes[1] == sizes[2] > sizes[3] > 100
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    empty = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, data)
        assert empty_out.count() == 0


def test_the_whole_pipeline_equals_brute_force(spark, tmp_path):
    """run() over planted documents: what the stages keep, and the packed pieces of the texts that brute force leaves."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(900)]

    def prose(n):
        words = rng.choices(vocabulary, k=n)
        for i in range(0, n, 11):
            words[i] = words[i].capitalize()
            words[max(0, i - 1)] += "."
        return " ".join(words)

    texts = {i: prose(rng.randint(60, 140)) for i in range(40)}
    items = {i: prose(40) for i in range(3)}
    passage = prose(70)
    texts |= {100 + i: texts[i] for i in range(4)}  # exact copies
    texts |= {200 + i: texts[i].replace(" ", "  ", 3).rsplit(" ", 2)[0] for i in range(4, 8)}  # near copies
    texts |= {300 + i: f"{prose(60)}\n{passage}\n{prose(60)}" for i in range(3)}
    texts |= {400 + i: f"{prose(30)} {items[i]} {prose(30)}" for i in range(3)}
    texts |= {500 + i: "zap%%% zip### zop&&& x$$$ " * rng.randint(9, 15) + str(i) for i in range(12)}
    texts |= {600: None, 601: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))

    good = {i: t for i, t in texts.items() if t and not 500 <= i < 600}
    tokens = lambda t: re.findall(r"\w+", t.lower())
    bag = lambda t: Counter(tuple(t[k : k + 5]) for k in range(len(t) - 4))
    alike = lambda a, b: (a & b).total() >= 0.8 * (a | b).total()
    kept = []
    for i in sorted(good):
        if not any(alike(bag(tokens(good[i])), bag(tokens(good[j]))) for j in kept):
            kept.append(i)
    left = brute_repeats([(i, good[i]) for i in kept], substrings.MIN_RUN)

    def leaks(words):
        for item in items.values():
            target = bag(tokens(item))
            if any(alike(bag(words[k : k + target.total() + 4]), target) for k in range(max(1, len(words) - target.total() - 3))):
                return True
        return False

    truth = {i: [w.lower() for w in words] for i, words in left.items() if not leaks([w.lower() for w in words])}
    docs, tables = spark.read.parquet(str(tmp_path / "sf/documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch(stage(spark, docs, str(tmp_path / "sf")), "stage")
        tables.append({r.doc_id: r.text for r in docs.collect()})
    assert set(tables[0]) == set(good) and set(tables[1]) == set(kept)
    assert {i: tokens(t) for i, t in tables[2].items()} == {i: [w.lower() for w in words] for i, words in left.items()}
    assert {i: tokens(t) for i, t in tables[3].items()} == truth and not {400, 401, 402} & set(truth)
    out = corpus_pipeline.run(spark, str(tmp_path / "sf")).toPandas()
    count = packing.counter(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(count.exact(t)) // 4 + 1 for i, t in tables[3].items()}
    assert out.groupby("doc_id").length.sum().to_dict() == sizes
    spread = out.sort_values(["sequence_id", "offset"])
    assert (spread.groupby("sequence_id").length.cumsum() - spread.length == spread.offset).all() and out.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_pass_awkward_rows_and_columns(spark):
    prose = "A plain sentence of ordinary words, nothing more. We walked along the river, and it was late. "
    rows = [(i, prose + f"Then came {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} to us. " * 3, 1, "x", 2) for i in range(30)]
    rows += [rows[3], (None, None, 1, "x", 2), (None, "", 1, "x", 2), (90, "word " * 60_000 + ".", 1, "x", 2), (91, "中文 текст", 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, removed string, row int")
    benchmark = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch(stage(spark, docs, benchmark), "stage")
        assert out.columns == docs.columns and 1 <= out.count() <= docs.count(), name
        assert {(r.id, r.removed, r.row) for r in out.collect()} == {(1, "x", 2)}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, benchmark).count() >= len(rows)


BODY = "<h1>Head</h1><p>one two three four five six</p><p>seven eight nine ten</p>"
TEXT = "Head\none two three four five six\nseven eight nine ten"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='site has-sidebar'><article>{BODY}</article></div>", TEXT),
        (f"<div class='layout no-sidebar'><main>{BODY}</main></div>", TEXT),
        (f"<div class='page nav-open'>{BODY}</div>", TEXT),
        (f"<article class='post category-social'>{BODY}</article>", TEXT),
        (f"<article class='post with-comments'>{BODY}</article>", TEXT),
        (f"<form id='aspnetForm'><nav>menu</nav>{BODY}<input></form>", TEXT),
        (f"<aside><main>{BODY}</main></aside>", TEXT),
        (f"<body style='visibility:hidden'><div class='sidebar'>{BODY}</div></body>", TEXT),
        (f"<article>{BODY}<p class='notice'>kept</p><math>a+b</math><object>c</object></article>", TEXT + "\nkept\na+bc"),
        (f"<div class='cookie-notice'>ok?</div><div id='sideBar'>x</div><ul class='main-menu'><li>a</ul><article>{BODY}</article>", TEXT),
        (f"<article>{BODY}<div id='comments'>no</div><div class='post-share'>s</div><aside>q</aside><form>f</form></article><footer>f<article>teaser</article></footer>", TEXT),
        (f"<div class='related'><article>teaser</article></div><article>{BODY}</article>", TEXT),
    ],
)
def test_names_of_wrappers_and_articles_lose_no_content(page, text):
    assert html.main_text(page) == text
