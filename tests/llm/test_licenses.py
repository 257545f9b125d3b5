import random
import re

from contextlake.llm import licenses
from contextlake.llm.licenses import license_scan

SCHEMA = "doc_id long, text string, labels string"


def plain(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    places = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(words)) if tuple(words[p : p + len(phrase)]) == phrase]
    at = sorted(p for p, _ in places)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


def accepts(markup, words):
    """The template as a regular expression over words, by a plain rewriting."""
    out = ""
    for mark, text in re.findall(r"<<([^>]*)>>|([^<]+)", markup):
        if mark == "beginOptional":
            out += "(?:"
        elif mark == "endOptional":
            out += ")?"
        elif mark:
            out += r"(?:\S+ ){0,%s}" % re.search("max=([0-9]+)", mark)[1]
        else:
            out += "".join(re.escape(w) + " " for w in re.findall("[a-z0-9]+", text.lower()))
    return re.search(r"(?:^| )" + out, " " + "".join(w + " " for w in words)) is not None


def test_equal_to_plain_versions(spark):
    rng = random.Random(2)
    parts = ["MIT License", "mit", "license", "Apache-License", "GNU General Public License, version 3", "licensed under", "the", "CC BY-NC 4.0", "CC", "BY", "SA", "All rights reserved.", "rights", "Straße", "x\x7fy", "日本", "BSD license", "2 clause", "terms of the", "\n", "redistribution"]
    rows = [(i, rng.choice([" ", "", ", "]).join(rng.choice(parts) for _ in range(rng.randrange(12))), "z") for i in range(600)]
    rows += [(700, None, None), (701, "", "z"), (None, "MIT License", "z"), (702, "word " * 200_000 + "mit license", "z")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text), text
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        want = {k for k, v in licenses.TEMPLATES.items() if accepts(v, words)} | set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(want)), text
        assert 0 <= r.score <= 1 and (r.score == 1) == any(accepts(v, words) for v in licenses.TEMPLATES.values())


def test_mandatory_wording_is_exact():
    a = licenses.compile_template("x", "made <<beginOptional>> only <<endOptional>> by <<var;max=2>> here")
    assert a.mandatory == 3
    for text, want in [("made by here", True), ("made only by a b here", True), ("made by a b c here", False), ("made only here", False), ("made b here", False)]:
        assert a.run(text.encode().split(), 0)[0] == want


def test_empty(spark):
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_score_of_a_partial_match_needs_no_other_word(spark):
    compiled = [licenses.compile_template(k, v) for k, v in licenses.TEMPLATES.items()]
    texts = ["this is free and", "all rights", "nothing here"]
    want = [licenses.scan([w.encode() for w in x.split()], [(a, a.starts()) for a in compiled])[1] for x in texts]
    got = {r.doc_id: r.score for r in licenses.license_scan(spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)], SCHEMA)).collect()}
    assert [got[i] for i in range(3)] == want and want[0] > 0.3 and want[1] == 0.5 and want[2] == 0


def parsed(markup):
    """Markup as nested lists: words, ("var", n) and ("opt", list)."""
    stack = [[]]
    for mark, wording in re.findall(r"<<([^>]*)>>|([^<]+)", markup):
        if mark == "beginOptional":
            stack.append([])
        elif mark == "endOptional":
            done = stack.pop()
            stack[-1].append(("opt", done))
        elif mark:
            stack[-1].append(("var", int(mark.split("max=")[1])))
        else:
            stack[-1] += [w.lower() for w in wording.split()]
    return stack[0]


def plain_score(markup, words):
    """Best share over all places, by trying every way through the template."""

    def run(nodes, at):
        if not nodes:
            return True, 0
        head, rest = nodes[0], nodes[1:]
        if isinstance(head, str):
            if at >= len(words) or words[at] != head:
                return False, 0
            ok, n = run(rest, at + 1)
            return ok, n + 1
        if head[0] == "word":
            return run(rest, at + 1) if at < len(words) and words[at] == head[1] else (False, 0)
        if head[0] == "var":
            ways = [run(rest, at + k) for k in range(min(head[1], len(words) - at) + 1)]
        else:
            ways = [run(rest, at), run([("word", x) if isinstance(x, str) else x for x in head[1]] + rest, at)]
        return any(ok for ok, _ in ways), max(n for _, n in ways)

    nodes = parsed(markup)
    mandatory = sum(isinstance(x, str) for x in nodes)
    found = [run(nodes, at) for at in range(len(words))]
    return max((1.0 if ok else n / (mandatory + 1) for ok, n in found), default=0.0)


def test_score_equals_brute_force(spark):
    templates = {"a": "red green <<beginOptional>> very <<beginOptional>> dark <<endOptional>> <<endOptional>> blue", "b": "green <<var;max=2>> blue red", "c": "<<beginOptional>> dark <<endOptional>> red red"}
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["red", "green", "very", "dark", "blue", "x"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan(rows, templates=templates).collect():
        assert r.score == max(plain_score(m, texts[r.doc_id].split()) for m in templates.values()), texts[r.doc_id]


def test_partial_wordings_and_templates_without_mandatory_words(spark):
    rows = spark.createDataFrame([(1, "all rights"), (2, "all rights license"), (3, "maybe so"), (4, "z")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in license_scan(rows).collect()}
    assert got[1] == got[2] == 0.5
    free = {"opt": "<<beginOptional>> maybe <<endOptional>>", "none": "", "any": "<<var;max=1>> so"}
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(rows, templates=free).collect()}
    assert got[3] == ("any,opt", 1.0) and got[4] == ("", 0.0) and got[1] == ("", 0.0)


def test_whole_texts_are_accepted():
    for label in ("mit-text", "bsd-text", "isc-text", "apache-text"):
        markup = licenses.TEMPLATES[label]
        wording = re.sub(r"<<var[^>]*>>", " the authors ", re.sub(r"<<(begin|end)Optional>>", " ", markup)).lower().encode().split()
        automaton = licenses.compile_template(label, markup)
        assert automaton.mandatory > 70
        assert automaton.run(wording, 0)[0] and not automaton.run(wording[:-1], 0)[0]
