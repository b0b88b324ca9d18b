"""Training-data operators against plain Python, on small tables with every odd case."""

import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenry.llm import components, languages, leaks, mixture, near_equal, overlap, pairs, templates, terms, truncation
from lumenry.stage import clear_stages, stage


def tok(text):
    return re.sub(r"[^a-z0-9\s']", "", text.lower()).split()


def near(a, b, limit=0.7):
    x, y = set(tok(a or "")), set(tok(b or ""))
    return len(x) >= 5 and len(y) >= 5 and 10 * len(x & y) >= round(10 * limit) * len(x | y)


SENTENCES = [
    "a small brown dog runs over the green hill at dawn",
    "two children play with a red ball near the old harbour",
    "an old sailor mends a torn net beside the quiet pier",
    "the tired baker carries warm bread through the narrow street",
]


def edited(rng, text):
    words = text.split()
    for _ in range(rng.randint(0, 3)):
        kind, at = rng.randint(0, 2), rng.randrange(len(words))
        if kind == 0:
            words.insert(at, rng.choice(["very", "quite", "just"]))
        elif kind == 1 and len(words) > 6:
            words.pop(at)
        else:
            other = rng.randrange(len(words))
            words[at], words[other] = words[other], words[at]
    return " ".join(words)


ODD = [None, "", "   ", "!!!", "one two three", "word " * 5000]


# Near-equal rows


def caption_rows(seed=3, n=70):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = edited(rng, rng.choice(SENTENCES)), edited(rng, rng.choice(SENTENCES))
        rows.append((i, a, b))
    for i, odd in enumerate(ODD):
        rows += [(1000 + 2 * i, odd, rows[0][2]), (1001 + 2 * i, rows[0][1], odd)]
    rows += [(2000, rows[0][1], rows[0][2]), (2001, rows[0][1], rows[0][2])]
    return rows


def brute_pairs(rows):
    return {(min(x[0], y[0]), max(x[0], y[0])) for x, y in itertools.combinations(rows, 2) if near(x[1], y[1]) and near(x[2], y[2])}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_equal_rows_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_equal, "BLOCK_ROWS", block)
    rows = caption_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "k long, one string, two string, id string, text int")
    found = [(r.a, r.b) for r in near_equal.near_equal_rows(df, "k", "one", "two").collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_pairs(rows)


@pytest.mark.parametrize("block", [1024, 3])
def test_near_equal_groups_are_the_components_of_the_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_equal, "BLOCK_ROWS", block)
    rows = caption_rows(5)
    df = spark.createDataFrame(rows, "k long, one string, two string")
    got = {r.k: r.group_id for r in near_equal.near_equal_groups(df, "k", "one", "two").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(rows):
        parent[find(a)] = find(b)
    wanted = {}
    for x in parent:
        wanted.setdefault(find(x), []).append(x)
    assert got == {x: min(members) for members in wanted.values() for x in members}


def test_long_texts_are_linked_by_few_combinations(spark):
    rng = random.Random(4)
    texts = []
    for n in (20, 62, 66, 90, 250, 262, 1200, 6000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for share in (0.0, 0.05, 0.15, 0.2, 0.35):
            some = rng.sample(base, round(n * (1 - share)))
            texts += [" ".join(sorted(set(some))), " ".join(sorted({*some, *(f"v{rng.randrange(10**6)}" for _ in range(round(n * share / 2)))}))]
    for n in (1000, 6000):
        assert sum(len(c) for o in near_equal._orders(n, Fraction(7, 10), 3) for c in itertools.combinations(range(near_equal._bounds(n, Fraction(7, 10), o)[1]), o)) < 100_000
    wanted = {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(texts), 2) if near(x, y)}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = [(r.a, r.b) for r in near_equal.near_equal_links(df).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_near_equal_of_nothing(spark):
    df = spark.createDataFrame([], "k long, one string, two string")
    assert near_equal.near_equal_rows(df, "k", "one", "two").collect() == []
    assert near_equal.near_equal_groups(df, "k", "one", "two").collect() == []


# Components and splits


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"p{i}", f"p{i + 1}") for i in range(30)]
    edges += [(None, "n1"), ("n2", None), ("n3", "n3"), edges[0], edges[0]]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            parent[find(a)] = find(b)
    assert set(got) == set(parent)
    for a, b in itertools.combinations(sorted(got), 2):
        assert (got[a] == got[b]) == (find(a) == find(b))


def test_photo_names(spark):
    names = [
        "1234567890_00ffaa1122.jpg", "Images/1234567890_00FFAA1122.JPG", "1234567890%5F00ffaa1122.jpg?w=640", "1234567890-00ffaa1122-2.png",
        "1234567890_00ffaa1123.jpg", "1234567891_00ffaa1122.jpg", "640x480", "", None, "1234567890", "12345678901_00ffaa1122.jpg",
    ]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names * 2)], "image_id string, component int")
    got = {(r.image_id_a, r.image_id_b) for r in components.same_photo_names(df).collect()}
    assert got == {tuple(sorted(p)) for p in itertools.combinations(names[:4], 2)}


def test_splits_keep_photos_and_shares(spark):
    rows = [(i, f"{1000000000 + i // 5}_{i // 5:010x}.jpg", ["joyful", "sad", "tense", "romantic", "humorous"][i % 5], i % 5) for i in range(3000)]
    rows += [(9000 + i, "5555555555_abcdefabcd.jpg", "Sad.", None) for i in range(300)]
    rows += [(9900, None, None, None), (9901, None, "joyful", 0), (9902, "odd name", "x", None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "row_id long, image_id string, emotion string, emotion_id int, split string")
    got = {r.row_id: r.split for r in components.split_captions(df).collect()}
    assert len(got) == len(rows)
    by_photo, sizes, styles = {}, {}, {}
    for row_id, name, _, style in rows:
        if name:
            by_photo.setdefault(name, set()).add(got[row_id])
        sizes[got[row_id]] = sizes.get(got[row_id], 0) + 1
        if style is not None and row_id < 9000:
            styles.setdefault(style, {}).setdefault(got[row_id], []).append(row_id)
    assert all(len(s) == 1 for s in by_photo.values())
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sizes[name] / len(rows) - share) < 0.03
    for parts in styles.values():
        assert abs(len(parts["test"]) / 600 - sizes["test"] / len(rows)) < 0.04


def test_splits_of_nothing(spark):
    df = spark.createDataFrame([], "row_id long, image_id string, emotion string, emotion_id int")
    assert components.split_captions(df).collect() == []
    assert components.same_photo_names(df).collect() == []


# Terms


def test_terms_match_a_counter(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "ab", "abc", "abd", "b's", "zoo", "zone", "z9"]) for _ in range(rng.randint(0, 9))) for _ in range(80)] + ODD + ["once"]
    df = spark.createDataFrame([(t, 1) for t in texts], "said string, term int")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.marked_terms(df, "said", burst=2).collect()}
    total, rows, n = {}, {}, sum(t is not None for t in texts)
    for t in texts:
        for w in tok(t or ""):
            total[w] = total.get(w, 0) + 1
        for w in set(tok(t or "")):
            rows[w] = rows.get(w, 0) + 1
    mark = {w: "rare" if total[w] < 2 else "common" if rows[w] > 0.25 * n else None for w in total}
    assert got == {w: (total[w], rows[w], mark[w]) for w in total}


def test_burst_trie_and_packing():
    rng = random.Random(4)
    trie, plain = terms.BurstTrie(burst=3), {}
    for _ in range(500):
        w = "".join(rng.choice("ab'") for _ in range(rng.randint(1, 6)))
        trie.add(w, 2, 1)
        plain[w] = plain.get(w, 0) + 1
    out = {p + rest: tuple(c) for p, held in trie.leaves() for rest, c in held.items()}
    assert out == {w: (2 * n, n) for w, n in plain.items()}
    rows = [(w, 2 * n, n) for w, n in plain.items()]
    assert list(terms.unpack(terms.pack(rows))) == sorted(rows)


def test_heavy_routes_are_deepened(spark):
    words = ["".join(p) for p in itertools.product("abc", repeat=6)]
    df = spark.createDataFrame([(" ".join(words),)], "said string")
    got = terms.term_counts(df, "said", route_terms=20).collect()
    assert sorted(r.term for r in got) == sorted(words) and all(r.occurrences == 1 for r in got)


def test_terms_of_nothing(spark):
    assert terms.marked_terms(spark.createDataFrame([], "said string"), "said").collect() == []


# Truncation and pairs


def written(seed=0, n=900):
    rng = random.Random(seed)
    who, what, where = ["clown", "baker", "sailor", "nurse", "farmer"], ["kicks", "mends", "lifts", "paints"], ["harbour", "market", "stadium", "orchard", "library"]
    tails = ["while the quiet river keeps singing", "as the evening hours fall like feathers", "and nobody ever tells the moon about it"]
    whole = []
    for _ in range(n):
        s = f"The {rng.choice(who)} slowly {rng.choice(what)} a lantern beside the {rng.choice(where)}"
        if rng.random() < 0.7:
            s += " " + rng.choice(tails)
        whole.append(s)
    return whole


def test_truncated_rows(spark):
    rng = random.Random(9)
    rows, cut = [], set()
    for i, s in enumerate(written()):
        u = rng.random()
        if i % 10 == 0:
            words = s.split()
            at = rng.randrange(5, len(words) - 1)
            t = " ".join(words[:at]) + " " + words[at][: max(1, len(words[at]) // 2)] if u < 0.5 else " ".join(words[:at]) + rng.choice([" [", "\\u00", "&am", "�"])
            cut.add(i)
        else:
            t = s + (". " if u < 0.7 else "..." if u < 0.8 else "")
        rows.append((i, t, None, "src", 1))
    rows += [(5000 + i, odd, None, None, 0) for i, odd in enumerate([None, "", " ", "!!", "Hi", "word " * 3000 + "."])]
    df = spark.createDataFrame(rows, "row_id long, said string, asked string, source string, how int")
    got = {r.row_id for r in truncation.truncated_rows(df, "row_id", "said", "asked").collect()}
    missed, wrong = cut - got, got - cut
    assert len(wrong) <= 2, [rows[i] for i in wrong]
    assert len(missed) <= len(cut) * 0.12, [rows[i] for i in missed]
    rates = {r.source: (r.n_rows, r.n_cut) for r in truncation.truncation_rates(df, "row_id", "said", "source").collect()}
    assert rates["src"][0] == 900 and rates[None][0] == 6 and rates["src"][1] == len(got)


@pytest.mark.parametrize("times", [1, 8])
def test_beginnings_that_stand_elsewhere_are_cut_at_any_size(spark, times):
    rng = random.Random(2)
    said = [f"{s} answers with nothing but silence." for s in written(3, 90 * times)]
    said += [f"The {w} {i} says si to the moon beside the sea." for i, w in enumerate(["clown", "nurse"] * times)]
    said += [f"Nadie espera cuando el {rng.random()} dice si."] * 3 * times
    said += [f"The nurse number {i} looks at the wide open sea." for i in range(20 * times)] + [f"A {i} season of the sea begins." for i in range(20 * times)]
    rows = [(i, t, None) for i, t in enumerate(said)]
    rows += [(-1, "The old lamp of the tower answers with nothing but si", None), (-2, "A man on the hill looks at the wide open sea", None)]
    df = spark.createDataFrame(rows, "row_id long, said string, asked string")
    assert {r.row_id: r.reason for r in truncation.truncated_rows(df, "row_id", "said", "asked").collect()} == {-1: "word"}


def test_foreign_rows_judge_as_one_by_one():
    texts = [tok(x) for x in ("der alte hund und die katze", "the dog and the cat", "", "el perro de la casa in the house", "a la el")]
    words = sorted({w for t in texts for w in t})
    codes, row = (np.array(x) for x in zip(*((words.index(w), i) for i, t in enumerate(texts) for w in t)))
    assert languages.foreign_rows(words, codes, row, len(texts)).tolist() == [languages.foreign_words(t) for t in texts]


def test_near_copy_tells_a_cut():
    full = tok("the quick brown fox jumps over the lazy dog near the river bank today")
    assert truncation.aligned_end(full[:-2], full[:-2], truncation.GOES_ON) == "early"
    assert truncation.aligned_end([*full[:-1], "tod"], full, truncation.CLOSES) == "inside"
    assert truncation.aligned_end(full, full, truncation.CLOSES | truncation.GOES_ON) == "same"
    assert truncation.aligned_end(tok("nothing alike at all here today"), full, truncation.CLOSES) is None
    other = tok("a slow green bird sings under a warm sun near the river bank today")
    assert truncation.aligned_end(full, other, truncation.GOES_ON) is None


@pytest.mark.parametrize("share", [0.3, 0.45, 0.6, 0.75, 0.9])
def test_cut_copies_are_told_by_their_whole(spark, share):
    rng = random.Random(int(share * 100))
    vocabulary = [f"{a}{b}{c}" for a in ("bri", "sto", "cla", "mer", "pol") for b in ("nde", "ta", "lo", "vi") for c in ("n", "rk", "st", "sh")]
    rows, cut = [], set()
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(30)]
        whole = " ".join(words)
        rows.append((3 * i, whole.capitalize() + ".", None))
        at = int(len(whole) * share)
        while whole[at] == " " or whole[at - 1] == " " or not whole[at - 2 : at].isalpha():
            at += 1
        part = whole[:at].split()
        if i % 3 == 0 and len(part) > 14:  # a near-copy: one word differs
            part[1] = "another"
        rows.append((3 * i + 1, " ".join(part), None))
        cut.add(3 * i + 1)
        rows.append((3 * i + 2, whole, None))  # the whole without its full stop
    df = spark.createDataFrame(rows, "row_id long, said string, asked string")
    got = {r.row_id: r.reason for r in truncation.truncated_rows(df.repartition(5), "row_id", "said", "asked").collect()}
    copies = {k for k, v in got.items() if v == "copy"}
    assert copies <= cut and len(copies) >= 0.98 * len(cut)  # a sketch may miss one in a hundred near-copies
    assert set(got) <= cut and len(got) >= 0.98 * len(cut)


def test_texts_that_share_a_phrase_make_no_pairs(spark, monkeypatch):
    said = "the old keeper of the tower walks along the quiet shore with "
    long = "lantern" * 9
    rows = [(i, f"{said}x{i}q") for i in range(40)] + [(100 + i, f"{said}y{i}z.") for i in range(40)]
    rows += [(200, f"{said}lan"), (201, f"{said}lantern."), (202, f"an {said}{long[:50]}"), (203, f"an {said}{long}.")]
    staged = {}

    def kept(df, name):
        staged[name] = stage(df, name)
        if name == "facts":
            staged["others"] = staged[name].where(F.col("kind") == truncation._COPY).select("x").distinct().count()
        return staged[name]

    monkeypatch.setattr(truncation, "stage", kept)
    df = spark.createDataFrame([(i, text, "a prompt of a scene") for i, text in rows], "row_id bigint, said string, asked string")
    got = {r.row_id: r.reason for r in truncation.truncated_rows(df, "row_id", "said", "asked").collect()}
    assert got[200] == got[202] == "copy"
    assert staged["others"] == 2  # 201 and 203
    monkeypatch.setattr(truncation, "PAIRS_AT_ONCE", 1)
    assert {r.row_id: r.reason for r in truncation.truncated_rows(df, "row_id", "said", "asked").collect()} == got
    clear_stages()


def test_truncation_of_nothing(spark):
    df = spark.createDataFrame([], "row_id long, said string, asked string, source string")
    assert truncation.truncated_rows(df, "row_id", "said", "asked").collect() == []
    assert pairs.broken_pairs(df, "row_id", "asked", "said").collect() == []


CASES = [
    (None, "empty"), ("", "empty"), (" \n", "empty"), ("N/A", "empty"), ("(no output)", "empty"), ("-", "empty"), ("​", "empty"),
    ("I'm sorry, but I can't rewrite this caption.", "refusal"), ("This goes against the guidelines!", "refusal"),
    ("I am sorry, little moon, the clown lifts a lantern beside the harbour.", None),
    ("A CLOWN IN A RED COAT IS LIFTING A HEAVY STONE NEAR THE OLD MILL", "copy"),
    ("Rewrite the caption to sound sad: a clown in a red coat is lifting a heavy stone near the old mill", "copy"),
    ("a clown in a red coat is gladly lifting a heavy stone near the old mill (sad)", "copy"),
    ("Der alte Matrose wartet still am Ufer, während die Nacht langsam vergeht.", "language"), ("Старый почтальон ждёт в саду.", "language"),
    ("市場の漁師はとても悲しい。", "language"), ("Lost in the scent of crème brûlée, the clown weeps by the mill.", None),
    ("The clown weeps beside the mi [", "truncated"),
]


def test_defects(spark):
    prompt = "A clown in a red coat is lifting a heavy stone near the old mill."
    rows = [(i, prompt, "sad", t) for i, (t, _) in enumerate(CASES)] + [(100, None, "sad", "The clown weeps by the mill."), (101, "", None, None)]
    got = {r.row_id: r.defect for r in pairs.broken_pairs(spark.createDataFrame(rows, "row_id long, asked string, defect string, said string"), "row_id", "asked", "said").collect()}
    assert got == {i: d for i, (_, d) in enumerate(CASES) if d} | {101: "empty"}


@pytest.mark.parametrize("text", [
    "Can't do that one, sorry!", "I'm sorry, but I can't create that caption.", "Sorry, I cannot provide a caption for it.", "I won't write this.",
    "Unfortunately I am unable to generate the requested caption", "I’m afraid I can’t do that.", "We respectfully decline to write such a caption.",
])
def test_refusals_by_grammar(spark, text):
    prompt = "A clown in a red coat is lifting a heavy stone near the old mill."
    df = spark.createDataFrame([(1, prompt, text), (2, None, text)], "row_id long, asked string, said string")
    assert [r.defect for r in pairs.broken_pairs(df, "row_id", "asked", "said").collect()] == ["refusal", "refusal"]


@pytest.mark.parametrize("text", [
    "I am sorry, little moon, the clown cannot help the sailor.", "The nurse cannot write this letter without tears.", "He cannot do that, sorry as he is.",
    "I cannot give this heart away beside the quiet mill", "Sorry, whispers the clown, and the dog will not turn.",
])
def test_scenes_are_no_refusals(text):
    assert not pairs.is_refusal(tok(text), tok("A clown with a sad heart sits near an old mill while a sailor and a nurse read a letter beside a dog"))


# Written before the grammar was run on them.
UNSEEN_REFUSALS = [
    "Sorry, I can't create that caption.", "I am unable to generate a caption for this image.", "I refuse to answer.", "I'm afraid I cannot comply with this request.",
    "As an AI, I don't have feelings to express.", "My guidelines do not permit this kind of content.", "I would prefer not to write about this.",
    "Please provide a different image and I will try again.", "That request falls outside what I can do.", "I do not have access to the picture.",
    "Unfortunately, I won't be able to help you with that.", "I have to decline this one.", "We cannot fulfil your request at this time.",
    "It is not possible for me to rewrite this sentence.", "I apologize, but this caption violates our content policy.", "There is not enough information to write a caption.",
    "I don't feel comfortable writing that.", "This content is not appropriate, so I must decline.", "Could you share the photo first?", "I can't do this, sorry.",
]
UNSEEN_FOREIGN = [
    "Stary marynarz czeka na brzegu, kiedy noc powoli się kończy.", "Den gamle mand sidder ved havnen og ser på sin hund.", "Yaşlı adam ve köpeği denizin yanında bir gün daha bekliyor.",
    "Seorang anak kecil bermain dengan bola di taman yang hijau.", "En gammal man sitter på en bänk och väntar på sin hund.", "Vanha mies ja hänen koiransa istuvat rannalla, mutta yö on jo tullut.",
    "Egy öreg ember ül a padon, és nem tudja, hogy mikor jön az éj.", "Un home vell espera amb el seu gos quan arriba la nit.", "Bătrânul stă pe bancă și așteaptă să vină noaptea din nou.",
    "Một người đàn ông ngồi bên bờ biển với con chó của mình.", "Starý muž sedí na lavičce a čeká, až se vrátí jeho pes.", "Một ngày nữa đã trôi qua và không có ai.",
    "Hann situr á bekknum og horfir á sjóinn með hundinum.", "Ninguém sabe por que o velho ainda espera na praça.", "Die Frau und der Hund sind nicht mehr zu sehen.",
]
UNSEEN_ENGLISH = [
    "Man in hat sits at bar.", "Two dogs, one ball, no mercy!", "Die hard fans sing in the rain.", "O sun, come home to me at last.", "La la la sings the little girl in pink.",
    "An old man and his dog sit on a pier at dawn.", "Lonely pier, pale moon, cold tea.", "With a bon appetit and a grand adieu, the chef leaves the table.",
    "Pour me a pint, says the sad sailor.", "War is over for the tired men in the tent.",
]


def test_defects_not_looked_at_before(spark):
    prompt = "A clown in a red coat is lifting a heavy stone near the old mill."
    texts = UNSEEN_REFUSALS + UNSEEN_FOREIGN + UNSEEN_ENGLISH
    df = spark.createDataFrame([(i, prompt, t) for i, t in enumerate(texts)], "row_id long, asked string, said string")
    got = {r.row_id: r.defect for r in pairs.broken_pairs(df, "row_id", "asked", "said").collect()}
    n, m = len(UNSEEN_REFUSALS), len(UNSEEN_REFUSALS) + len(UNSEEN_FOREIGN)
    missed = [texts[i] for i in range(n) if got.get(i) != "refusal"] + [texts[i] for i in range(n, m) if got.get(i) != "language"]
    assert sum(got.get(i) == "refusal" for i in range(n)) >= 0.9 * n, missed
    assert sum(got.get(i) == "language" for i in range(n, m)) >= 0.9 * (m - n), missed
    assert not [texts[i] for i in range(m, len(texts)) if got.get(i) in ("refusal", "language")]


def test_suffix_automaton_covers_as_brute_force_does():
    rng = random.Random(6)
    for _ in range(200):
        a, b = [rng.choice("abc") for _ in range(rng.randint(1, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
        on = set()
        for i, j in itertools.combinations(range(len(b) + 1), 2):
            if j - i >= 2 and any(a[k : k + j - i] == b[i:j] for k in range(len(a))):
                on |= set(range(i, j))
        assert pairs.SuffixAutomaton(tuple(a)).covered(b) == len(on)


# Overlap


@pytest.mark.parametrize("parts", [2, 7])
def test_overlaps_match_brute_force(spark, parts):
    rng = random.Random(8)
    schema = "row_id long, image_id string, emotion_id int, emotion_caption string, source string, side int"
    rows = []
    for i in range(120):
        base = " ".join([*rng.choice(SENTENCES).split(), *(f"w{rng.randrange(12)}" for _ in range(4))])
        rows.append((i, f"{1000000000 + rng.randrange(50)}_00000000aa.jpg" if i % 3 else None, rng.choice([None, 0, 1]), edited(rng, base), rng.choice(["a", None]), 0))
    rows += [(200 + i, None, None, odd, "a", 0) for i, odd in enumerate(ODD * 2)]
    split = rows[:70] + rows[120:126], rows[70:100] + rows[126:], rows[100:120]
    train, test, val = (spark.createDataFrame(p, schema).repartition(parts) for p in split)
    got = {(r.train_row, r.eval_row) for r in overlap.overlapping_rows(train, [test, val]).collect()}

    def photo(x, y):
        return x[1] and x[1] == y[1] and x[2] is not None and x[2] == y[2]

    held = split[1] + split[2]
    assert got == {(x[0], y[0]) for x in split[0] for y in held if near(x[3], y[3]) or photo(x, y)}
    report = overlap.overlap_report(train, {"test": test, "val": val}).collect()
    assert sum(r.n_pairs for r in report) == len(got)
    spans = {tuple(w[i : i + 5]) for x in split[0] for w in [tok(x[3] or "")] for i in range(len(w) - 4)}
    wanted = {}
    for y in held:
        if w := tok(y[3] or ""):
            wanted[y[0]] = (len(w), len({j for i in range(len(w) - 4) if tuple(w[i : i + 5]) in spans for j in range(i, i + 5)}))
    assert {r.row_id: (r.n_words, r.covered) for r in overlap.covered_words(train, [test, val]).collect()} == wanted


def test_overlaps_under_one_phrase_are_whole(spark):
    schema = "row_id long, image_id string, emotion_id int, emotion_caption string, source string"
    start = "w1 w2 w3 w4 w5 w6"
    said = lambda i: f"{start} {' '.join(f'x{i % 5}{j}' for j in range(4))} y{i}"
    train = spark.createDataFrame([(i, None, None, said(i), "a") for i in range(1500)], schema)
    test = spark.createDataFrame([(10000 + i, None, None, said(i) + "b", "a") for i in range(1500)], schema)
    got = overlap.overlapping_rows(train, [test])
    # Ten of twelve words are shared by those of one kind.
    assert got.count() == 5 * 300 * 300 and got.where("train_row % 5 <> (eval_row - 10000) % 5").count() == 0


def test_overlaps_of_texts_under_one_full_node_or_in_another_order(spark):
    schema = "row_id long, image_id string, emotion_id int, emotion_caption string, source string"
    start = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"
    train = [(i, None, None, f"{start} x{i}", "a") for i in range(1100)] + [(5000, None, None, f"{start} x9000", "a"), (5001, None, None, "c e a b d g f h", "a")]
    test = [(9000 + i, None, None, f"{start} x{9000 + i}", "a") for i in range(3)] + [(9100, None, None, "a b c d e f g h", "a")]
    train, test = spark.createDataFrame(train, schema), spark.createDataFrame(test, schema)
    got = {(r.train_row, r.eval_row) for r in overlap.overlapping_rows(train, [test]).collect()}
    assert got == {(i, 9000 + j) for i in (*range(1100), 5000) for j in range(3)} | {(5001, 9100)}


def test_overlap_of_nothing(spark):
    schema = "row_id long, image_id string, emotion_id int, emotion_caption string, source string"
    empty = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, "1234567890_00ffaa1122.jpg", 1, SENTENCES[0], "a")], schema)
    assert overlap.overlapping_rows(empty, [empty]).collect() == []
    assert overlap.overlapping_rows(one, [empty]).collect() == []
    assert overlap.overlapping_rows(empty, [one]).collect() == []


# Leaks


def test_leaks_match_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40))), "x") for i in range(12)] + [(90, None, "x"), (91, "", "x")]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 2:
            source = tok(rng.choice(items[:12])[1])
            n = min(len(source), rng.choice([9, 11, 12, 13, 20]))
            at = rng.randrange(len(source) - n + 1)
            spot = rng.randrange(len(words) + 1)
            words[spot:spot] = source[at : at + n]
        docs.append((i, " ".join(words).title() + ".", 7))
    docs += [(900, None, 7), (901, "", 7), (902, "word1 " * 4000, 7)]
    a = spark.createDataFrame(items, "item_id long, text string, doc string")
    b = spark.createDataFrame(docs, "doc_id long, text string, item int")
    found = leaks.leaked_passages(a, b, "item_id", "doc_id").where("longest_run >= 12").collect()
    got = {(r.item_id, r.doc_id) for r in found}

    def runs(text):
        w = tok(text or "")
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    assert got == {(i[0], d[0]) for i in items for d in docs if runs(i[1]) & runs(d[1])}
    assert leaks.leaked_passages(a.limit(0), b, "item_id", "doc_id").collect() == []
    assert leaks.leaked_passages(a, b.limit(0), "item_id", "doc_id").collect() == []


def test_pairs_are_counted_alike_by_both_ways():
    pair = np.random.default_rng(0).integers(0, 50, 400)
    assert (leaks._often(pair, 50) == leaks._often(pair, leaks.COUNTER + 1)).all() and (leaks._often(pair, 50) == np.bincount(pair)[pair]).all()


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 100)
    text = " ".join(f"w{i}" for i in range(30))
    a = spark.createDataFrame([(i, text + f" end{i}") for i in range(4)], "item_id long, text string")
    b = spark.createDataFrame([(1, "before " + text + " after")], "doc_id long, text string")
    assert len(leaks.leaked_passages(a, b, "item_id", "doc_id").collect()) == 4


# Mixtures


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["a", " A", "b", "B ", "other", None]), "word " * rng.randint(1, 30), 5) for i in range(2000)] + [(5000, "c", None, 1), (5001, "c", "", 1)]
    targets = [("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.1, 4), ("d", 0.1, 4)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, size int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    sized = mixture.word_sizes(d, "doc_id", "text")
    report = {r.source: r for r in mixture.mixture_report(sized, t, "doc_id").collect()}
    total = sum(len(x[2].split()) for x in docs if x[1] and x[2] and x[1].strip().lower() in "ab")
    assert report["a"].total_size == total
    assert {s for s, r in report.items() if r.short} == {"c", "d"}
    for s in "ab":
        assert abs(report[s].reached_size - report[s].wanted_size) < 0.05 * total
    sample = mixture.systematic_sample(sized, mixture.mixture_plan(sized, t), "doc_id", bucket_rows=100).collect()
    assert len({r.doc_id for r in sample}) == len(sample) and all(1 <= r.copies <= 3 for r in sample)
    copies = sum(r.copies for r in sample if r.source == "a")
    expected = {r.source: r.copies for r in mixture.mixture_plan(sized, t).collect()}["a"] * sum(1 for x in docs if x[1] and x[1].strip().lower() == "a")
    assert abs(copies - expected) <= 1
    assert mixture.mixture_report(sized.limit(0), t, "doc_id").where("short").count() == 4
    assert mixture.mixture_report(sized, t.limit(0), "doc_id").collect() == []


def test_token_sizes(spark):
    d = spark.createDataFrame([(1, "a", "hello world", 3), (2, None, None, 3), (3, "a", "", 3), (4, "b", "<|endoftext|>", 3)], "doc_id long, source string, text string, size int")
    got = {r.doc_id: r["size"] for r in mixture.token_sizes(d, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1


# Templates

RESIDUE = {
    "404 Not Found.": "error", "<h1>Internal Server Error (500).": "error", "Please enable JavaScript to continue.": "script",
    "Text goes here. asdf qwer asdf qwer": "filler", "Lorem ipsum dolor sit amet consectetur": "filler", "Dear {{name}}, thank you.": "slot",
    "A dog guarding [INSERT CAPTION HERE].": "slot", "A plain sentence about a dog.": None, "The museum had a print of a \"404 Not Found\" sign.": None,
    "We told the class why a page may ask you to enable JavaScript.": None, "In our template the slot written as {emotion} is replaced.": None,
}


def test_template_residue(spark):
    plain = "The camera stood 12 steps from the harbour."
    rows = [(i, t, "x") for i, t in enumerate(RESIDUE)] + [(100 + i, f"{plain} {t}\n{plain}", "x") for i, t in enumerate(RESIDUE)]
    rows += [(500, None, "x"), (501, "", "x"), (502, plain * 3000, "x"), (0, "404 Not Found.", "x")]
    got = {}
    for r in templates.template_residue(spark.createDataFrame(rows, "doc_id long, text string, doc string"), "doc_id", "text").collect():
        got.setdefault(r.doc_id, set()).add(r.defect)
    wanted = {k + i: {d} for i, d in enumerate(RESIDUE.values()) if d for k in (0, 100)}
    assert got == wanted
    assert templates.template_residue(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect() == []


def test_templates_merge():
    leaf = templates.Leaf()
    ids = {leaf.add(templates.tokens(f"We counted {i} photos with a {w} and a hat."), 2) for i, w in enumerate(["dog", "cat", "bird"])}
    assert ids == {0} and leaf.templates[0] == "we counted <#> photos with a <*> and a hat".split()
    assert leaf.fillers[0] == {6: {"dog", "cat", "bird"}} and leaf.documents == [6]


def test_varying_words_tell_a_sentence_from_a_message(spark):
    told = "Every visitor to the {} knows that the page was not found on this server in spring."
    fixed = "That picture was moved by its owner (request 17)."
    one = spark.createDataFrame([(1, told.format("dune")), (2, fixed)], "doc_id long, text string")
    assert {r.doc_id for r in templates.template_residue(one, "doc_id", "text").collect()} == {1}
    words = ["dune", "mill", "quarry", "pond", "harbour", "market", "library", "stadium"]
    rows = [(i, f"A fine day. {told.format(w)} And so on.") for i, w in enumerate(words)]
    rows += [(100 + i, f"A {w}. {fixed.replace('17', str(i))} The {w} again.") for i, w in enumerate(words)]
    rows += [(200 + i, f"The page was not found on this server. The {w}.") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 6):
        got = {(r.doc_id, r.defect) for r in templates.template_residue(df.repartition(parts), "doc_id", "text").collect()}
        assert got == {(i, "error") for i in [*range(100, 108), *range(200, 208)]}


# Written without a look at the test tables; all but the last of each kind before the patterns were run on them.
MESSAGES = [
    "This site can't be reached", "You have been blocked.", "We couldn't find the page you requested.", "Sorry, this content isn't available right now.", "Insert text here",
    "Oops! That page can’t be found.", "502 Bad Gateway nginx/1.18.0", "Error establishing a database connection", "The requested URL was not found on this server.",
    "Please turn on JavaScript in your browser to use this site.", "This video is no longer available.", "Your connection timed out, please try again in a few minutes.",
    "NullPointerException: at com.foo.Bar.baz(Bar.java:12)", "Access to this resource is forbidden", "We are performing scheduled maintenance.", "Hello [Your Name], welcome to {{company}}.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem", "Your caption here", "Dear ${firstName}, thanks", "La page que vous cherchez n'existe plus.",
    "Die Seite konnte nicht gefunden werden.", "Image failed to load", "Request rate limit exceeded", "asdfasdf qwerty asdf", "test test test test", "The gateway did not respond in time.",
    "Your session has expired, please sign in again.", "Animals such as {{name}} are welcome.",
]
SENTENCES_BESIDE = [
    "The page of the book was blank.", "A dog found a link of a chain on the page.", "He could not find the photo in the album of his aunt.", "The server brought two plates to the table.",
    "We visited the gallery and the picture was gone for repair.", "The error was mine, she said later.", "Browser tabs and cold tea: my whole afternoon.", "He had permission to enter the garden.",
    "They tried again later that day.", "The gate was forbidden to visitors after dark.", "An animal and its labour, a minister and a temple.", "The doctor said that that was that.",
]


def test_messages_of_other_wording(spark):
    texts = MESSAGES + SENTENCES_BESIDE
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in templates.template_residue(df, "doc_id", "text").collect()}
    n = len(MESSAGES)
    assert len([i for i in range(n) if i in got]) >= 0.9 * n, [texts[i] for i in range(n) if i not in got]
    assert not [texts[i] for i in range(n, len(texts)) if i in got]
