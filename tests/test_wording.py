"""How sentences are read: one line per sentence, with what must come out of it."""

import pytest

from millrace.operators import wording as w

#: sentence, relations it asserts (kind, turned round), terms it takes back.
SENTENCES = [
    ("P-1 feeds T-2.", [("flow", False)], ""), ("P-1 is feeding T-2.", [("flow", False)], ""), ("P-1, feeding T-2, is small.", [("flow", False)], ""), ("P-1 supplies T-2 with water.", [("flow", False)], ""),
    ("P-1 discharges to T-2.", [("flow", False)], ""), ("P-1 discharges into T-2.", [("flow", False)], ""), ("P-1 delivers to T-2.", [("flow", False)], ""), ("P-1 delivers the product to T-2.", [("flow", False)], ""),
    ("P-1 sends fluid to T-2.", [("flow", False)], ""), ("P-1 sends the medium on to T-2.", [("flow", False)], ""), ("Liquid from P-1 flows to T-2.", [("flow", False)], ""), ("What leaves P-1 flows into T-2.", [("flow", False)], ""),
    ("T-2 is fed by P-1.", [("fed", True)], ""), ("T-2, fed from P-1, is big.", [("fed", True)], ""), ("T-2 is supplied by P-1.", [("fed", True)], ""), ("T-2 was supplied from P-1.", [("fed", True)], ""),
    ("T-2 receives fluid from P-1.", [("fed", False)], ""), ("T-2 receives its feed from P-1.", [("fed", False)], ""), ("T-2 receives from P-1.", [("fed", False)], ""),
    ("T-2 is downstream of P-1.", [("downstream", False)], ""), ("P-1 lies upstream from T-2.", [("upstream", False)], ""), ("The downstream pump P-1 is here.", [], ""),
    ("A-3 operates V-4.", [("operates", False)], ""), ("A-3 actuates V-4.", [("operates", False)], ""), ("A-3 acts on V-4.", [("operates", False)], ""), ("A-3 controls V-4.", [("operates", False)], ""),
    ("V-4 is operated by A-3.", [("operates", True)], ""), ("V-4 is controlled by A-3.", [("operates", True)], ""), ("V-4, actuated by A-3, is a valve.", [("operates", True)], ""), ("A-3 is controlling V-4.", [("operates", False)], ""),
    ("The control function A-3 and V-4 stand together.", [], ""), ("A-3 is on the signal list.", [], ""), ("The supply line of P-1 ends at T-2.", [], ""), ("The flow between P-1 and T-2 is drawn.", [], ""),
    ("C-5 sends its signal to A-3.", [("sends_signal_to", False)], ""), ("C-5 sends the output to A-3.", [("sends_signal_to", False)], ""), ("C-5 transmits to A-3.", [("sends_signal_to", False)], ""), ("C-5 transmits its signal to A-3.", [("sends_signal_to", False)], ""), ("C-5 signals to A-3.", [("sends_signal_to", False)], ""),
    ("S-6 senses at V-4.", [("senses_at", False)], ""), ("S-6 measures at V-4.", [("senses_at", False)], ""), ("S-6 takes its measurement at V-4.", [("senses_at", False)], ""), ("S-6 senses V-4.", [("senses_at", False)], ""),
    ("S-6 passes its measurement to C-5.", [("measurement_input_to", False)], ""), ("S-6 sends measurements to C-5.", [("measurement_input_to", False)], ""), ("S-6 feeds the reading to C-5.", [("measurement_input_to", False)], ""),
    ("P-1 does not feed T-2.", [], "T-2"), ("P-1 doesn't feed T-2.", [], "T-2"), ("P-1 never feeds T-2.", [], "T-2"), ("P-1 feeds T-2, not T-9.", [("flow", False)], "T-9"), ("P-1 feeds T-2 rather than T-9.", [("flow", False)], "T-9"), ("P-1 feeds T-2 instead of T-9.", [("flow", False)], "T-9"),
    ("No row shows that P-1 feeds T-2.", [], "P-1 T-2"), ("Without T-9, P-1 feeds T-2.", [("flow", False)], "T-9"), ("There is no bypass, and P-1 feeds T-2.", [("flow", False)], ""), ("P-1 feeds T-2 but not T-9.", [("flow", False)], "T-9"), ("Neither T-8 nor T-9 is here; P-1 feeds T-2.", [("flow", False)], "T-8 T-9"),
    ("You said T-9 feeds P-1, but P-1 feeds T-2.", [("flow", False)], "T-9 P-1"), ("You asked whether T-9 feeds P-1.", [], "T-9 P-1"), ("Your assumption that T-9 feeds P-1 is noted.", [], "T-9 P-1"), ("Assuming T-9 feeds P-1, P-1 feeds T-2.", [("flow", False)], "T-9 P-1"), ("Did you mean T-9?", [], "T-9"), ("It is unconfirmed that T-9 feeds P-1.", [], "T-9 P-1"),
    ("If you follow the pipes, P-1 feeds T-2.", [("flow", False)], ""), ("P-1 feeds T-2, as your drawing shows.", [("flow", False)], ""), ("P-1 feeds T-2 - and T-3.", [("flow", False)], ""), ("P-1 feeds V-4 and operates V-7.", [("flow", False), ("operates", False)], ""),
    ("P-1 → T-2", [], ""), ("", [], ""), ("P–1 feeds T‑2.", [("flow", False)], ""),
]


@pytest.mark.parametrize(("sentence", "relations", "back"), SENTENCES)
def test_relations_and_what_is_taken_back(sentence, relations, back):
    got = w.read_sentence(sentence)
    assert [(r.kind, r.passive) for r in got.relations] == relations
    assert " ".join(t.term for t in got.terms if not t.asserted) == back


@pytest.mark.parametrize(
    ("prose", "sentences"),
    [
        ("P1 feeds V1. [E1.1] V1 is shut.\nThe valves are:\n- V1 [E2.1]\n- V2\n[E3.1]", ["P1 feeds V1 [E1.1].", "V1 is shut.", "The valves are: [E2.1]", "- V1 [E2.1]", "- V2 [E3.1]"]),
        ("A1 feeds B2. [E1.3] Next one! [E1.1, R2]", ["A1 feeds B2 [E1.3].", "Next one [E1.1, R2]!"]),
        ("Two of them [E1.1] and three [R2].", ["Two of them [E1.1] and three [R2]."]),
        ("Listed:\n- A1\n- B2\n[R1]", ["Listed: [R1]", "- A1 [R1]", "- B2 [R1]"]),
        ("First. [E1.1]\n- A1\n[R1]\n- B2", ["First [E1.1].", "- A1 [R1]", "- B2"]),
        ("It has 6.0 bar. Is it P-1.2? Yes", ["It has 6.0 bar.", "Is it P-1.2?", "Yes"]),
        ("[R1]", ["[R1]"]), ("\n\n", []), ("", []), ("A1 [E1.1][E1.2].", ["A1 [E1.1] [E1.2]."]), ("A1 is here [note 7]. B2", ["A1 is here [note 7].", "B2"]),
    ],
)
def test_sentences_and_their_citations(prose, sentences):
    assert w.sentences_of(prose) == sentences


def test_citations():
    got = w.read_sentence("P1 [E1.3, E1.3; R2] feeds V1 [E1] [E1.x] [E1.1 - E1.4] [ref 3] [evidence: step 1] [see above].")
    assert got.refs == ["E1.3", "R2"] and got.broken == ["[E1]", "[E1.x]", "[E1.1 - E1.4]", "[ref 3]", "[evidence: step 1]"]


def test_terms():
    text = "Pump P-100 on DN 80, DN50 has 6.0 bar, 60kW, 12 m3/h, the 2nd GlobeValve 4712/C1 at - 45.0 °C or -5 %, 4712 of 12, PIS⁺Z⁺A275003 in Water"
    assert [(t.term, t.kind) for t in w.terms_of(text)] == [
        ("P-100", "identifier"), ("DN 80", "nominal_diameter"), ("DN50", "nominal_diameter"), ("6.0 bar", "value_with_unit"), ("60kW", "value_with_unit"), ("12 m3/h", "value_with_unit"),
        ("GlobeValve", "type_name"), ("4712/C1", "identifier"), ("45.0 °C", "value_with_unit"), ("5 %", "value_with_unit"), ("4712", "number"), ("PIS⁺Z⁺A275003", "identifier"),
    ]
    assert [t.minus for t in w.terms_of("-45.0 °C and 45.0 °C")] == [True, False]
    assert all(text[t.at : t.at + len(t.term)] == t.term for t in w.terms_of(text))


@pytest.mark.parametrize(
    ("sentence", "live"),
    [
        ("P-100 is running and V1 is open.", True), ("V1 is shut.", True), ("V1 is currently open.", True), ("V1 is at the moment drawn.", True), ("The pump is stopped.", True), ("V1 remains closed.", True), ("P1 is off.", True),
        ("V2 has an open end.", False), ("V2 is an open end.", False), ("V1 is not open.", False), ("The drawing does not say whether V1 is open.", False), ("V1 is operated by A1.", False), ("The pipe is open at V2.", False), ("The open valve symbol is V1.", False), ("You said V1 is open.", False),
    ],
)
def test_live_state(sentence, live):
    assert bool(w.read_sentence(sentence).live) == live


def test_roles_and_plant():
    assert w.read_sentence("The line V1, valve number P-2 and chambers #C3 are on lines of the pump.").roles == [("line", "V1"), ("valve", "P-2"), ("chamber", "C3")]
    assert w.read_sentence("It is the main cooling pump.").about_plant and w.read_sentence("It is used for cooling.").about_plant and not w.read_sentence("Here is what the graph shows.").about_plant
    assert not w.read_sentence("The drawing holds no weight for this pump.").about_plant


def test_claim_blocks():
    block = '```claims\n[{"predicate": "is_a"}]\n```'
    assert w.split_answer(f"P1.\n\n## Claims:\n{block}") == ("P1.", [{"predicate": "is_a"}])
    assert w.split_answer(f"P1.\n**Structured claims**\n\n{block}\nmore") == ("P1.\nmore", [{"predicate": "is_a"}])
    assert w.split_answer('x\n```json\n{"predicate": "a"},\n[{"predicate": "b"}]\n```\n') == ("x", [{"predicate": "a"}, {"predicate": "b"}])
    assert w.split_answer('```\n{"claims": ["odd"]}\n```') == ("", ["odd"]) and w.split_answer('```claims\n{"predicate": "a"}\n```')[1] == [{"predicate": "a"}]
    assert w.split_answer("text\n```claims\n{broken\n```") == ("text", None) and w.split_answer("text\n```claims\n[") == ("text", None)
    assert w.split_answer("a\n```python\nx = 1\n```\nb") == ("a\n```python\nx = 1\n```\nb", None) and w.split_answer(None) == ("", None)
    # Of several blocks the last one that can be read counts.
    assert w.split_answer(f"{block}\nmid\n```json\n[]\n```")[1] == [] and w.split_answer(f"{block}\nmid\n```json\nnope\n```")[1] == [{"predicate": "is_a"}]


def test_long_texts_take_linear_time():
    for piece in ("[", "[E1.1]", "P-1 feeds T-2, ", "a.b-c/", "not ", ". ", "\n", "you said ", "```"):
        long = piece * 20_000
        list(w.read(long[:200_000]))
        w.split_answer(long)
