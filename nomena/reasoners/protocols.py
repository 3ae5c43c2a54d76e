"""Protocols: how a model is asked to choose one of a mention's finalists. Each is a function of a way to ask and a case, and gives (id, transcript).

A case has: sample and evidence (texts), finalists (ids, the lead first), lead, scores (year plausibility by id), active (by id: whether the entity was active in the year), titles, year (or None), generic.
ask(messages, temperature=0.0, judge=False) gives the answer's text. Prompts are plain; what counts is who sees what, in which order, and how answers become one id.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

Ask = Callable[..., str]


def parse_object(text: str | None) -> dict | None:
    """The JSON object between the outermost braces, else the first flat one that names an entity_id."""
    text = text or ""
    parts = [text[text.find("{") : text.rfind("}") + 1] if "{" in text else "", *re.findall(r'\{[^{}]*"entity_id"[^{}]*\}', text)[:1]]
    for part in parts:
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def picked(text: str | None, finalists: list[int], fallback: int) -> tuple[int, object]:
    """(id, confidence): the id that the answer names if it is a finalist, else the fallback."""
    obj = parse_object(text)
    told = obj.get("entity_id") if obj else None
    if obj is None:
        m = re.search(r'"entity_id"\s*:\s*(\d+)', text or "") or re.search(r"entity_id[=\s]+(\d+)", text or "")
        told = m[1] if m else None
    try:
        told = int(told)
    except (TypeError, ValueError):
        told = None
    return told if told in finalists else fallback, obj.get("confidence") if obj else None


def _says(role: str, *parts: str) -> dict[str, str]:
    return {"role": role, "content": "\n\n".join(p for p in parts if p)}


def _system(case: dict, task: str) -> dict[str, str]:
    kind = "Each candidate is a record of a knowledge base." if case["generic"] else "Candidates may be generations of one name; the year tells who bore it."
    return _says("system", f"You link a mention in a historical text to one candidate. {kind} {task}")


def _ids(case: dict) -> str:
    return ", ".join(map(str, case["finalists"]))


def _case(case: dict) -> str:
    return f"{case['sample']}\n\nCandidates:\n{case['evidence']}"


def _choose(case: dict, how: str = "") -> str:
    return f'{how} Answer with JSON: {{"entity_id": one of {_ids(case)}, "confidence": 0 to 1}}'.strip()


def bare(ask: Ask, case: dict) -> tuple[int, dict]:
    """One question."""
    a = ask([_system(case, "Choose."), _says("user", _case(case), _choose(case))])
    return picked(a, case["finalists"], case["lead"])[0], {"answer": a}


def step_by_step(ask: Ask, case: dict, think: bool = True, era: str = "") -> tuple[int, dict]:
    """Reasoning first, then the answer read off it; think=False is one question."""
    ground = [_system(case, "Choose."), _says("user", _case(case), era, "Let us think step by step." if think else _choose(case))]
    a = ask(ground)
    if not think:
        return picked(a, case["finalists"], case["lead"])[0], {"answer": a}
    b = ask([*ground, _says("assistant", a), _says("user", _choose(case, "So, which one is it?"))])
    return picked(b, case["finalists"], case["lead"])[0], {"reasoning": a, "answer": b}


def plan_and_solve(ask: Ask, case: dict, careful: bool = False) -> tuple[int, dict]:
    """A plan carried out, then the answer; careful asks for the facts and years to be noted first."""
    how = "Understand the task, note the facts and years that matter, devise a plan, and carry it out, checking each step." if careful else "Understand the task, devise a plan, and carry it out step by step."
    ground = [_system(case, "Choose."), _says("user", _case(case), how)]
    a = ask(ground)
    b = ask([*ground, _says("assistant", a), _says("user", _choose(case))])
    return picked(b, case["finalists"], case["lead"])[0], {"solution": a, "answer": b}


def self_consistency(ask: Ask, case: dict, paths: int = 5, temperature: float = 0.7) -> tuple[int, dict]:
    """The majority of several paths; ties go to the more plausible year, then to the lead, then to who came first."""
    ground = [_system(case, "Think step by step, then choose."), _says("user", _case(case), _choose(case))]
    answers = [ask(ground, temperature=temperature) for _ in range(paths)]
    votes = Counter(picked(a, case["finalists"], case["lead"])[0] for a in answers)
    best = max(votes, key=lambda i: (votes[i], case["scores"].get(i, 0), i == case["lead"])) if votes else case["lead"]
    return best, {"votes": dict(votes), "paths": answers}


def chain_of_verification(ask: Ask, case: dict) -> tuple[int, dict]:
    """A first answer, questions that would test it, their answers without sight of it, and a final answer."""
    first = ask([_system(case, "Choose."), _says("user", _case(case), _choose(case))])
    pick, _ = picked(first, case["finalists"], case["lead"])
    questions = ask([_system(case, "Doubt."), _says("user", _case(case), f"Someone chose {pick}. Write up to four short questions, a line each, whose answers would show whether that is right.")])
    lines = [q.strip() for q in questions.splitlines() if q.strip()][:4]
    facts = [f"Q: {q}\nA: " + ask([_system(case, "Answer only what is asked, from the records."), _says("user", _case(case), q)]) for q in lines]
    last = ask([_system(case, "Choose."), _says("user", _case(case), "Checked facts:\n" + "\n".join(facts), f"The first choice was {pick}.", _choose(case))])
    return picked(last, case["finalists"], pick)[0], {"first": first, "questions": lines, "facts": facts, "answer": last}


VIEWS = ("the people named around the mention", "the time and place it speaks of", "what kind of thing is meant")


def views(ask: Ask, case: dict) -> tuple[int, dict]:
    """Three kinds of knowledge are mined, each leads to a pick, as does none; if all agree that is it, else a judge selects, and what the judge garbles goes to the most plausible year."""
    mined = [ask([_system(case, "Gather."), _says("user", case["sample"], f"Write down {v}, as keywords.")]) for v in VIEWS]
    answers = [ask([_system(case, "Choose."), _says("user", _case(case), f"Helpful: {m}" if m else "", _choose(case))]) for m in ("", *mined)]
    picks = [picked(a, case["finalists"], case["lead"])[0] for a in answers]
    if len(set(picks)) == 1:
        return picks[0], {"mined": mined, "picks": picks}
    judged = ask([_system(case, "Judge."), _says("user", _case(case), "Proposed: " + ", ".join(map(str, picks)), _choose(case, "Select the best of the proposed."))], judge=True)
    safe = max(dict.fromkeys(picks), key=lambda i: case["scores"].get(i, 0))
    return picked(judged, list(dict.fromkeys(picks)), safe)[0], {"mined": mined, "picks": picks, "judge": judged}


def rated(text: str | None) -> int:
    """A rating from 0 to 100, -1 if the answer has none."""
    obj = parse_object(text)
    value = obj.get("score") if obj else None
    if value is None:
        m = re.search(r"\b(100|\d{1,2})\b", text or "")
        value = m[1] if m else -1
    try:
        return max(-1, min(100, int(float(value))))
    except (TypeError, ValueError):
        return -1


def sample_and_rerank(ask: Ask, case: dict, samples: int = 3, temperature: float = 0.7) -> tuple[int, dict]:
    """Some picks by chance and one without, then a judge rates each different pick alone; best rating, then votes, then year."""
    ground = [_system(case, "Think step by step, then choose."), _says("user", _case(case), _choose(case))]
    answers = [*(ask(ground, temperature=temperature) for _ in range(samples)), ask(ground)]
    votes = Counter(picked(a, case["finalists"], case["lead"])[0] for a in answers)
    rating = {i: rated(ask([_system(case, "Rate."), _says("user", _case(case), f'How well does candidate {i} fit? Answer with JSON: {{"score": 0 to 100}}')], judge=True)) for i in votes}
    return max(votes, key=lambda i: (rating[i], votes[i], case["scores"].get(i, 0))), {"votes": dict(votes), "ratings": rating}


def debate(ask: Ask, case: dict, rounds: int = 2, verify: bool = False, interpret: bool = False) -> tuple[int, dict]:
    """One side defends the lead, the other the strongest rival; after the rounds a moderator decides. verify: a sceptic challenges the decision and the moderator may revise it. interpret: the old text is put in plain words first, for all."""
    told = _case(case)
    if interpret and not case["generic"]:
        told += "\n\nIn plain words: " + ask([_system(case, "Interpret."), _says("user", case["sample"], "Say plainly what the text says, and list the people named with the mention.")])
    opening = [_system(case, "Debate."), _says("user", told, f"Argue that candidate {case['lead']} is meant.")]
    ours, theirs, log = list(opening), list(opening), []
    a = ask(ours)
    log.append(f"for, 1: {a}")
    ours.append(_says("assistant", a))
    theirs += [_says("assistant", a), _says("user", f"Weigh every candidate but {case['lead']}, take the strongest, and argue that it is meant.")]
    b = ask(theirs)
    log.append(f"against, 1: {b}")
    theirs.append(_says("assistant", b))
    for r in range(2, rounds + 1):
        ours.append(_says("user", f"They said: {b}\n\nAnswer for {case['lead']}."))
        a = ask(ours)
        ours.append(_says("assistant", a))
        theirs.append(_says("user", f"They said: {a}\n\nAnswer."))
        b = ask(theirs)
        theirs.append(_says("assistant", b))
        log += [f"for, {r}: {a}", f"against, {r}: {b}"]
    bench = [_system(case, "You moderate."), _says("user", told, "\n\n".join(log), _choose(case, "Decide."))]
    verdict = ask(bench, judge=True)
    final, _ = picked(verdict, case["finalists"], case["lead"])
    out = {"log": log, "verdict": verdict}
    if verify:
        doubt = ask([_system(case, "Doubt."), _says("user", told, f"The decision is {final}. What speaks against it?")], judge=True)
        again = ask([*bench, _says("assistant", verdict), _says("user", doubt, _choose(case, "Keep or revise."))], judge=True)
        final, _ = picked(again, case["finalists"], final)
        out |= {"doubt": doubt, "revised": again}
    return final, out


def year_gate(case: dict, pick: int) -> tuple[bool, str]:
    """False, and why, only if the pick was not active in the year and another finalist was."""
    rivals = [i for i in case["finalists"] if case["active"].get(i)]
    if case["year"] is None or case["active"].get(pick) or not rivals:
        return True, ""
    names = ", ".join(f"{i} ({case['titles'].get(i, '')})" for i in rivals)
    return False, f"{pick} was not active in {case['year']}; these were: {names}."


def reflexion(ask: Ask, case: dict, trials: int = 3, by_model: bool = False) -> tuple[int, dict]:
    """Solve, check, reflect on what was wrong and solve again. The check is the year's, or the model's own."""
    notes, trail, final = [], [], case["finalists"][0]
    for t in range(trials):
        a = ask([_system(case, "Choose."), _says("user", _case(case), "Learned so far:\n" + "\n".join(notes) if notes else "", _choose(case))])
        final, _ = picked(a, case["finalists"], final)
        trail.append(a)
        if t == trials - 1:
            break
        if by_model:
            v = parse_object(ask([_system(case, "Check."), _says("user", _case(case), f'The choice is {final}. Answer with JSON: {{"ok": true or false, "critique": text}}')], judge=True)) or {}
            fine, why = bool(v.get("ok", True)), str(v.get("critique", ""))
        else:
            fine, why = year_gate(case, final)
        if fine:
            break
        notes.append(ask([_system(case, "Reflect."), _says("user", f"You chose {final}. {why} What will you do differently?")]))
    return final, {"trail": trail, "trials": t + 1, "reflected": bool(notes)}


def era_of(ask: Ask, text: str) -> str:
    """The time a text speaks of, in a few words; empty where the model finds none."""
    a = ask([_says("system", "Name the era a text speaks of."), _says("user", text, 'Answer with the era in a few words, or "timeless".')]).strip()
    return "" if "timeless" in a.lower() else a


def with_tools(ask: Ask, case: dict, call: Callable[[str, dict], object], steps: int = 8) -> tuple[int, dict]:
    """A loop: the model calls lookups, written between marks, until it answers with an id; -1 if it never does."""
    messages = [_system(case, "Use the tools, then answer."), _says("user", case["sample"], _choose(case))]
    used = []
    for _ in range(steps):
        a = ask(messages)
        messages.append(_says("assistant", a))
        calls = raw_calls(a)
        if not calls:
            obj = parse_object(a)
            try:
                return int(obj["entity_id"]), {"calls": used, "answer": a}
            except (TypeError, KeyError, ValueError):
                messages.append(_says("user", _choose(case)))
                continue
        used += [n for n, _ in calls]
        messages.append(_says("user", "\n".join(json.dumps(call(n, args), ensure_ascii=False, default=str) for n, args in calls)))
    return -1, {"calls": used, "answer": None}


def raw_calls(text: str | None) -> list[tuple[str, dict]]:
    """Tool calls written between marks: name, marks, JSON object."""
    from ..functions.answers import TOOLS

    if not text or not ("<｜" in text or "<|" in text):
        return []
    marked, out = re.sub(r"<[|｜][^<>]*[|｜]>", "\x00", text), []
    for m in re.finditer(r"([A-Za-z_]\w*)\s*\x00[\x00\s]*(?=\{)", marked):
        if m[1] in TOOLS:
            try:
                args, _ = json.JSONDecoder().raw_decode(marked[m.end() :])
            except ValueError:
                args = {}
            out.append((m[1], args if isinstance(args, dict) else {}))
    return out


PROTOCOLS = {
    "bare": bare,
    "zscot": step_by_step,
    "plansolve": plan_and_solve,
    "selfcon": self_consistency,
    "cove": chain_of_verification,
    "maps": views,
    "rerank": sample_and_rerank,
    "mad": debate,
    "transmad": lambda ask, case: debate(ask, case, interpret=True),
    "reflexion": reflexion,
}
#: Calls that a mention with several finalists costs, for estimates: by protocol at its defaults.
CALLS = {"bare": 1, "zscot": 2, "plansolve": 2, "selfcon": 5, "cove": 7, "maps": 8, "rerank": 8, "mad": 5, "transmad": 6, "reflexion": 5}
