import hashlib
import random
import re
import time

from varloom.llm.pii import DIGIT_WORDS, KINDS, LOOKALIKES, added_spans, base_spans, find_pii, luhn


def slow(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def test_luhn():
    assert luhn("4539578763621486") and not luhn("4539578763621487")


def test_base_against_plain_patterns():
    rng = random.Random(2)
    pool = ["a", "b.c", "@", "@@", ".", "..", "1", "25", "255", "256", "1.2.3.4", " ", "-", "+1", "(", ")", "é", "\n", "4539578763621486", "x@y.z", "%_", "4539 5787-6362 1486", "00000"]
    for _ in range(6000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(14)))
        assert base_spans(text) == slow(text), text


def show(text):
    return [(KINDS[k], text[a:b]) for k, a, b in added_spans(text, base_spans(text))]


def test_disguises_map_back_to_the_source():
    assert show("mail jo.do (at) ex [dot] com now") == [("email", "jo.do (at) ex [dot] com")]
    assert show("mail jo at ex dot com now") == [("email", "jo at ex dot com")]
    assert show("jo@ex dot co dot uk") == [("email", "jo@ex dot co dot uk")]
    assert show("write јо@ех.com") == [("email", "јо@ех.com")]
    assert show("ip １９２.168.0.1 x") == [("ip", "１９２.168.0.1")]
    assert show("call +1 (353) five five five zero three two eight") == [("phone", "+1 (353) five five five zero three two eight")]
    assert show("é four five three nine five seven eight seven six three six two one four eight six é") == [("card", "four five three nine five seven eight seven six three six two one four eight six")]


def test_numbers_in_disguise():
    assert show("host 192 dot 168 dot 1 dot 1.") == [("ip", "192 dot 168 dot 1 dot 1")]
    assert show("host 192[.]168[.]1[.]1, up") == [("ip", "192[.]168[.]1[.]1")]
    assert show("host 10.0 dot 0.7") == [("ip", "10.0 dot 0.7")]
    assert show("host l27.O.0.1 and 1O.0.0.255") == [("ip", "l27.O.0.1"), ("ip", "1O.0.0.255")]
    assert show("call +44 2O7 946 O123 now") == [("phone", "+44 2O7 946 O123")]
    assert show("pay 4539 S787 6362 l486") == [("card", "4539 S787 6362 l486")]
    assert show("call plus four four two zero seven nine four six zero one two three") == [("phone", "plus four four two zero seven nine four six zero one two three")]
    assert show("+3S3 1 555 0328") == [("phone", "+3S3 1 555 0328")]


def test_joined_words_and_references():
    assert show("mail john_at_example_dot_com now") == [("email", "john_at_example_dot_com")]
    assert show("mail john-at-my-example-dot-co-dot-uk") == [("email", "john-at-my-example-dot-co-dot-uk")]
    assert show("mail john&#64;example&period;com") == [("email", "john&#64;example&period;com")]
    assert show("mail john&#x40;example.com &amp; go") == [("email", "john&#x40;example.com")]
    assert show("john&commat;example dot com") == [("email", "john&commat;example dot com")]


def test_planted_numbers_against_what_was_planted():
    """Addresses, cards and phone numbers whose digits or dots are disguised; every span is exact."""
    rng = random.Random(12)
    letter = {"0": "Oo", "1": "Il", "5": "S", "8": "B", "2": "Z"}
    lost, n = [], 0
    for i in range(1500):
        if i % 3 == 0:
            plain = ".".join(str(rng.randrange(256)) for _ in range(4))
        elif i % 3 == 1:
            d = [rng.randrange(10) for _ in range(15)]
            plain = next("".join(map(str, d)) + str(c) for c in range(10) if luhn("".join(map(str, d)) + str(c)))
            plain = rng.choice(["", " ", "-"]).join(plain[k : k + 4] for k in range(0, 16, 4))
        else:
            plain = f"+{rng.randrange(1, 99)} {rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"
        if i % 3 == 0 and rng.random() < 0.5:
            planted = rng.choice([" dot ", "[.]", " (dot) ", "_dot_"]).join(plain.split("."))
        else:
            words = [list(w) for w in re.split(r"([^0-9])", plain)]
            for w in words:  # at most half of a word
                places = [k for k, c in enumerate(w) if c in letter]
                for k in rng.sample(places, min(len(places), len(w) // 2)):
                    w[k] = rng.choice(letter[w[k]])
            planted = "".join("".join(w) for w in words)
        if planted == plain:
            continue
        n += 1
        text = f"Note: {planted}, and then"
        kind = ("ip", "card", "phone")[i % 3]
        if (kind, planted) not in show(text):
            lost.append(planted)
    assert n > 1000 and len(lost) <= 0.02 * n, (n, lost[:20])


def test_numbers_and_names_that_are_none():
    for t in ("the iPhone 5S and 3.5B in 1O1 cases", "version 1.2.3 dot 4 dot 5", "look_at_this and the_dot_product", "&#233; and &#10; and &amp;", "300 dot 1 dot 1 dot 1", "two plus two", "12 dot 5 is at 3 dot 5"):
        assert show(t) == [], t


def test_disguises_of_any_length():
    """No limit on labels, dots, blanks or the distance of the signs."""
    for x in (f"john at {'a' * 70} dot com", "a at b dot c dot d dot e dot f dot g dot h dot com", "john dot smith at example dot com", "john     at\n\n   example \t dot    com", "j dot o dot e (at) ex dot com", f"{'a dot ' * 200}b at {'c dot ' * 200}com"):
        assert show(f"mail, {x}, now") == [("email", x)], x
    assert show("five   five  five, zero three-two eight five five five zero three two eight five zero and") == []


def test_planted_disguises_against_what_was_planted():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    look = {v: k for k, v in LOOKALIKES.items()}
    digits = {v: k for k, v in DIGIT_WORDS.items() if k != "oh"}
    clean = ["the", "river", "at", "noon", "is", "one", "point", "of", "2", "look", "house", "3.5", "and"]
    for _ in range(1500):
        kind, sep = rng.randrange(3), lambda: " " * rng.randrange(1, 6)
        if kind == 0:
            at = rng.choice([" at ", " (at) ", "[at]", f"{sep()}AT{sep()}", " @ ", "(@)", "@"])
            dots = lambda: rng.choice([" dot ", "(dot)", " [.] ", f"{sep()}DOT{sep()}", " punkt "])
            ends = dots() + word(rng.choice([2, 3, 80]))
            planted = word(rng.randrange(1, 90)) + "".join(dots() + word(3) for _ in range(rng.randrange(3) if at != "@" else 0)) + at + word(rng.randrange(1, 90)) + "".join(dots() + word(2) for _ in range(rng.randrange(8))) + ends
        elif kind == 1:
            plain = f"{word(4)}@{word(5)}.{word(3)}"
            planted = "".join(look.get(c, c) if rng.random() < 0.5 else c for c in plain)
            planted = planted if planted != plain else plain.replace("@", "\u200b@")
        else:
            planted = "+353 " + rng.choice([" ", ", ", " - "]).join(digits[rng.choice("0123456789")] for _ in range(7))
        before, after = rng.choice(["", "Note: ", "Look, ", f"{rng.choice(clean)}: "]), rng.choice(["", ".", ", and then", "\nThe river"])
        text = before + planted + after
        got = [(a, b) for k, a, b in added_spans(text, base_spans(text)) if k in (0, 3)]
        assert got == [(len(before), len(before) + len(planted))], (text, got)
    for _ in range(1500):
        text = " ".join(rng.choices([c for c in clean if c not in ("at", "point")], k=30))
        assert show(text) == [], text


def test_clean_texts_stay_clean():
    for t in ("We met at noon on the dot in town.", "one two three", "look at this. dot", "é at a, the dot", "", "a.b c@ d", "plain +1 (353) 555-0328 and x@y.org and 1.2.3.4"):
        assert show(t) == []


def test_long_runs_are_read_once():
    start = time.time()
    for t in ("a" * 10**6, "1" * 10**6, "1." * 10**6, "a@" * 10**5, "+1" * 10**5, "one " * 10**5, " at a" * 10**5, " dot a" * 10**5, "a at b dot " * 10**5, " " * 10**6, "a" + " " * 10**6 + "at", "(" * 10**5 + " " * 10**5, "one" + " " * 10**6 + "two", "x@" + " " * 10**6, "1 " * 10**6, "O" * 10**6, "1O " * 10**5, "a_at_" * 10**5, "a_dot_b" * 10**5, "1 dot " * 10**5, "&#64;" * 10**5, "&#" * 10**5, "plus " * 10**5, "1.O" * 10**5):
        base_spans(t)
        added_spans(t, [])
    assert time.time() - start < 30


def test_table(spark):
    texts = [None, "", "x@y.org +1 (353) 555-0328", "jo (at) ex dot com"]
    df = spark.createDataFrame([(None if i == 1 else i, t, 5) for i, t in enumerate(texts + texts)], "doc_id long, text string, spans int")
    rows = find_pii(df).collect()
    assert len(rows) == 8
    got = {r.doc_id: r for r in rows}
    assert got[2].spans == "email:0:7,phone:8:25" and got[2].base_sha256 == hashlib.sha256(b"email:0:7,phone:8:25").hexdigest() and (got[2].n_email, got[2].n_phone) == (1, 1)
    assert got[3].spans == "email:0:18" and got[3].n_email == 0 and got[3].n_added == 1
    assert got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert find_pii(df.limit(0)).count() == 0
