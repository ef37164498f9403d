import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import passages, residue

GOOD = ["The printer at till {n} prints only the upper half since Monday.", "Replied to the store: wait {n} minutes, then open the drawer with the key.", "Stock count for soft cheese differs by {n} from the ledger.", "Pekerja syif pagi telah membersihkan lorong {n} dan mengira laci tunai.", "冷柜温度升到 {n} 度，酸奶已经移走。", "Members with a gold card get RM {n} back on everything in Pets.", "The loyalty service answered with 503 Service Unavailable for {n} minutes, after which all calls went through.", "Our pages ask visitors to enable JavaScript; on tablet {n} this is switched on by the device profile."]
BAD = ["<html><head><title>404 Not Found</title></head><body><h1>404 Not Found</h1></body></html>", "Error 500: Internal Server Error", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet consectetur.\n\nDolor sit tempor amet consectetur elit.", "Sorry, we could not open that receipt. Go back to the start page.", "Your content goes here. Sample text.", "test test test test", "Sila aktifkan JavaScript untuk melihat halaman ini."]
SLOTS = ["{{name}}", "{{ name }}", "{{{name}}}", "{{name|default}}", "${name}", "$(name)", "#{name}", "{!name}", "{name}", "{0}", "%NAME%", "%%name%%", "%s", "@@NAME@@", "__NAME__", "[[name]]", "[NAME]", "[insert name here]", "[masukkan name]", "[TBC]", "<<NAME>>", "<name goes here>", "&lt;name&gt;", "<%= name %>", "{% name %}", "*|NAME|*", "【name】", "「填写name」", "(name to be filled in)", "XXXX", "undefined", "{{数量}}"]
EXPLAINS = ["In the mail editor write {s} where the outlet should appear; the sender fills it in for each member.", "The old templates used {s}; since spring it is replaced by the catalogue name before printing."]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    sentence = lambda: rng.choice(GOOD).format(n=rng.randrange(90))
    docs, want, doc_id = [], set(), 0
    for _ in range(900):
        docs.append((doc_id, " ".join(sentence() for _ in range(rng.randrange(1, 6)))))
        doc_id += 1
    for k in range(120):
        own = [sentence() for _ in range(3)]
        own.insert(1, rng.choice(EXPLAINS).format(s=SLOTS[k % len(SLOTS)]))
        docs.append((doc_id, " ".join(own)))
        doc_id += 1
    for s in SLOTS * 2:
        text = rng.choice(GOOD[:6]).replace("{n}", s)
        docs.append((doc_id, f"{sentence()} {text} {sentence()}"))
        want.add(doc_id)
        doc_id += 1
    for k in range(80):
        body = BAD[k % len(BAD)]
        docs.append((doc_id, f"Home | Offers | Stores | Contact\n\n{body}\n\n(c) 2026 All rights reserved." if k % 2 else body.upper() if k % 3 == 0 else body))
        want.add(doc_id)
        doc_id += 1
    docs += [(doc_id, None), (doc_id + 1, ""), (doc_id + 2, " \n\t ")]
    return docs, want


def test_held_out_accuracy(spark, corpus):
    docs, want = corpus
    rng = random.Random(9)
    rng.shuffle(docs)
    half = len(docs) // 2
    schema = "doc_id bigint, text string"
    models = residue.fit(spark.createDataFrame(docs[:half], schema))
    got = {r.doc_id for r in residue.find_residue(spark.createDataFrame(docs[half:], schema), models).collect()}
    real = want & {d[0] for d in docs[half:]}
    assert len(got & real) >= 0.97 * len(real) and len(got - real) <= 0.03 * len(real), (sorted(real - got), sorted(got - real))


def test_partitioning_does_not_matter(spark, corpus):
    docs, _ = corpus
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumnRenamed("text", "t").selectExpr("doc_id", "t as text", "'x' as feature")
    one = {r.doc_id for r in residue.find_residue(df.coalesce(1)).collect()}
    assert one == {r.doc_id for r in residue.find_residue(df.repartition(7)).collect()} and one


def cut(*texts):
    """The passages of the texts that have any, as one."""
    plain, page = passages.plain_texts(pa.array(texts, pa.string()))
    return passages.cut_passages(plain.to_pylist(), page)[0]


def has_slot(text):
    return bool((cut(text).words >= passages.GAP_WEAK).any())


def test_forms():
    assert all(has_slot(f"The maker is {s} on this shelf.") for s in SLOTS)
    assert not has_slot("100% sure, [1] and {} or a < b, SIZE XX and 50 %")
    p = cut("A first line.\n\nlonely {{slot}} in here\n\n- item: asdf asdf2 asdf")
    assert p.has(passages.SLOTTED).tolist() == [False, True, False] and not p.has(passages.REPEATED).any()
    for text in ("test test1 test testtest", "123 1231 123123 123", "XXXXX XXXX XX XXX", "测试测试测试", " ".join("a" * k for k in range(1, 80))):
        assert cut(text).has(passages.REPEATED).all(), text
    assert not cut("good morning good people", "1 2").has(passages.REPEATED).any()
    for text in (None, "", "\u200b \n", "..."):
        assert len(cut(text).first) == 0


def test_forms_with_any_blanks():
    for s in SLOTS:
        for blank in ("  ", "\n", " \n  ", "\u00a0 "):
            assert has_slot(f"A first line of this text.\n\nThe maker is {s.replace(' ', blank)} on this shelf."), (s, blank)
    assert has_slot("See <maker  goes   here> now.") and has_slot("See (harga  to be\nfilled in) now.")


def test_forms_have_no_greatest_length_and_are_seen_in_pages():
    for s in ("[" + "a" * 45 + "]", "[insert " + "some more " * 30 + "]", "%" + "x" * 60 + "%", "&lt;" + "x" * 60 + "&gt;", "【" + "字" * 60 + "】"):
        assert has_slot(f"The maker is {s} on this shelf."), s
    assert has_slot("<html><h1>Order</h1>Dear {{customer_name}}, thank you.</html>")


def test_words_and_passages():
    p = cut("One two. Three four-five! SKU-123 REG-05\n\n中文。好 e.g... so on\n- item")
    sizes = p.lengths().tolist()
    assert sizes == [2, 3, 2, 2, 5, 1]
    assert cut("at 19:28, RM 1,000.50 or 3/4").lengths().tolist() == [6] and cut("Error  404\nhere").has(passages.SEEDED).all()
    assert p.words[p.first[2]] == p.words[p.first[2] + 1]  # codes are one word, whatever their digits
    same = cut("Ábc déf", "ábc DÉF")
    assert same.words[:2].tolist() == same.words[2:].tolist() and same.docs.tolist() == [0, 1]


def random_models(seed=1):
    rng = np.random.default_rng(seed)
    numbers = lambda n: rng.random(n) * 9
    return residue.Models((numbers(residue.SIZE) + 9, numbers(residue.PLACES)), (numbers(residue.SIZE), numbers(residue.SIZE), numbers(residue.PLACES)), np.array([9.0, 4, 9, 3, 5, 90]), False)


def test_documents_together_are_judged_as_alone(corpus):
    texts = [t for _, t in corpus[0] if t and t.strip()][::40]
    m = random_models()
    together = residue.Scored(cut(*texts))
    assert together.decide(m).tolist() == [bool(residue.Scored(cut(t)).decide(m)[0]) for t in texts]
    for model in (None, m):
        alone = [residue.Scored(cut(t)).counts(model) for t in texts]
        counts, sums = together.counts(model)
        assert all(np.allclose(a, sum(x[0][k] for x in alone)) for k, a in enumerate(counts)) and np.allclose(sums, sum(x[1] for x in alone))
    fixed = [residue.Scored(cut(t)).fixed() for t in texts]
    assert all(np.allclose(a, sum(x[k] for x in fixed)) for k, a in enumerate(together.fixed()))


def test_a_long_text_is_cut_at_passages_and_judged_whole():
    text = "".join(f"Sentence number {k} is here and says something about shelf {k}.\n\n" for k in range(400))
    found = lambda size: list(passages.blocks([7], pa.array([text]), size))
    (ids, whole), (again, parts) = found(1 << 20)[0], found(3000)[0]
    assert ids.tolist() == again.tolist() == [7] and len(found(3000)) == 1
    assert whole.words.tolist() == parts.words.tolist() and whole.first.tolist() == parts.first.tolist() and parts.docs.tolist() == [0]
    assert len(list(passages.blocks([1, 2], pa.array(["a" * 5000, "b c"]), 1000))) == 2


def test_time_is_linear_in_the_text():
    import time

    for text in ("a" * 200_000, "a - " * 50_000, "{{a" * 60_000, "__a" * 60_000, "\n " * 100_000, "<a " * 60_000, "中文" * 80_000, "a| " * 60_000, "[insert " * 40_000):
        began = time.perf_counter()
        cut(text)
        assert time.perf_counter() - began < 5


ORDINARY = "Stock count for soft cheese differs by 4 from the ledger. Members with a gold card get RM 4 back on everything in Pets."
PROBES = [
    ("<h1>Order</h1> Dear {{customer_name}}, thank you for the order. " + ORDINARY, True), ("Dear {{customer_name}}, " + ORDINARY, True), (ORDINARY + " In templates, {{name}} is a variable.", False), (ORDINARY + " The warranty term is undefined.", False), (ORDINARY + " Shirts come in XXX only.", False),
    (ORDINARY + " See the table [above].", False), (ORDINARY + " The label said chese [sic] and nobody noticed.", False), (ORDINARY + " Members with a gold card get RM [TBC] back on everything in Pets.", True), (ORDINARY + " Stock count for soft cheese differs by undefined from the ledger.", True), (ORDINARY + " Stock count for soft cheese differs by XXX from the ledger.", True), ("XXXXX XXXX XXXXXX XX XXX", True),
]


def test_single_spellings_need_evidence(spark, corpus):
    docs, _ = corpus
    top = max(d[0] for d in docs) + 1
    df = spark.createDataFrame(docs + [(top + k, t) for k, (t, _) in enumerate(PROBES)], "doc_id bigint, text string")
    got = {r.doc_id for r in residue.find_residue(df).collect()}
    assert [top + k in got for k in range(len(PROBES))] == [bad for _, bad in PROBES]


# Residue of which no passage begins with a fixed beginning: found only if its words were learned from passages that do.
UNSEEDED = ["For safety reasons scripts must be allowed in the browser before that page opens.", "Go back to the start page; that receipt could not be opened.", "Your browser has scripts switched off, so nothing can be shown here.", "Nothing to see: the server gave up with an internal error.", "Dolor sit amet elit tempor consectetur, amet dolor sit elit.", "We looked everywhere, but that page is not on this server.", "Replace this text with your content before publishing."]
TEACHERS = ["Sorry, that receipt could not be opened. Go back to the start page.", "Please enable JavaScript: scripts must be allowed in the browser for safety before a page opens.", "JavaScript is disabled. Your browser has scripts switched off and nothing can be shown here.", "500 Internal Server Error. The server gave up; there is nothing to see here.", "Lorem ipsum dolor sit amet. Consectetur elit tempor dolor sit amet.", "404 Not Found. That page is not on this server; we looked everywhere.", "Sample text. Replace this text with your content before publishing."]


def test_recall_on_wording_without_a_fixed_beginning(spark):
    import re

    rng = random.Random(6)
    assert not any(re.match(passages.TRUSTED.replace("\\p{L}", "a-z"), t.lower()) for t in UNSEEDED)
    docs = [(k, " ".join(rng.choice(GOOD).format(n=rng.randrange(90)) for _ in range(rng.randrange(1, 6)))) for k in range(900)]
    docs += [(2000 + k, TEACHERS[k % len(TEACHERS)]) for k in range(70)]
    docs += [(3000 + k, f"Home | Offers | Stores | Contact\n\n{UNSEEDED[k % len(UNSEEDED)]}" if k % 2 else UNSEEDED[k % len(UNSEEDED)]) for k in range(42)]
    got = {r.doc_id for r in residue.find_residue(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    found = len({d for d in got if d >= 3000}) / 42
    assert found >= 0.9 and not any(d < 2000 for d in got), (found, sorted(d for d in got if d < 2000), [UNSEEDED[k % len(UNSEEDED)] for k in range(42) if 3000 + k not in got][:7])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert residue.find_residue(df).isEmpty()
