"""CI files as trees, and the jobs that GitHub, GitLab and Azure trees hold.

The reader goes over the lines of a file once, with a stack of the open mappings and sequences by their indent; it knows block and
flow collections, quoted and block scalars, comments, anchors, aliases and merge keys. What it can't read it leaves out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

KEY = re.compile(r"""("[^"]*"|'[^']*'|[^\s"'\[\]{}#&*!|>%@`,-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*))?$""")
FLOW = re.compile(r""""[^"]*"|'[^']*'|[\[\]{},]|:(?=\s|$)|(?:[^\[\]{},:"']|:(?!\s|$))+""")
#: Keys of a GitLab file that are no jobs, its stages if none are named, and the stages around all others.
GITLAB_KEYS = frozenset("default include stages variables workflow image services before_script after_script cache spec types".split())
GITLAB_STAGES, FIRST_STAGE, LAST_STAGE, PLAIN_STAGE = "build test deploy".split(), ".pre", ".post", "test"
#: Templates above a job's own that are followed.
MOST_TEMPLATES = 11


class Mapping(dict):
    """A mapping that knows the line of each key."""

    def __init__(self) -> None:
        super().__init__()
        self.lines: dict[str, int] = {}

    def put(self, key: str, value, line: int) -> None:
        self[key] = value
        self.lines[key] = line


@dataclass
class Job:
    name: str
    line: int
    runs_on: str = ""
    needs: list[str] = field(default_factory=list)
    n_steps: int = 0


def _bare(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def _without_comment(text: str) -> str:
    if "#" not in text:
        return text
    quote = ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or text[i - 1] in " [{,:"):
            quote = c
        elif c == "#" and (i == 0 or text[i - 1] in " \t"):
            return text[:i].rstrip()
    return text


def _flow(text: str, line: int, anchors: dict):
    root: list = []
    stack, keys, said = [root], [None], [""]

    def put(value) -> None:
        top = stack[-1]
        if isinstance(top, Mapping):
            if keys[-1] is not None:
                top.put(keys[-1], value, line)
                keys[-1] = None
        else:
            top.append(value)

    def flush() -> None:
        word, said[-1] = said[-1].strip(), ""
        if word:
            put(anchors.get(word[1:]) if word[0] == "*" else _bare(word))
        elif isinstance(stack[-1], Mapping) and keys[-1] is not None:
            put(None)

    for token in FLOW.findall(text):
        if token in "[{":
            new: list | Mapping = [] if token == "[" else Mapping()
            put(new)
            stack.append(new)
            keys.append(None)
            said.append("")
        elif token in "]}":
            flush()
            if len(stack) > 1:
                stack.pop()
                keys.pop()
                said.pop()
        elif token == ",":
            flush()
        elif token == ":" and isinstance(stack[-1], Mapping) and keys[-1] is None:
            keys[-1], said[-1] = _bare(said[-1]), ""
        else:
            said[-1] += token
    return root[0] if root else None


def read(text: str):
    """The tree of a file: Mapping, list, str or None."""
    anchors: dict = {}
    holder: list = []
    frames: list[list] = []  # indent and collection
    pending: tuple[int, Callable, str | None, bool] | None = None  # indent, setter, anchor, whether its key stands in a mapping
    scalar: tuple[int, Callable, list[str]] | None = None

    def value(said: str, no: int, indent: int, put: Callable, in_mapping: bool) -> None:
        nonlocal pending, scalar
        anchor = None
        while said[:1] in "&!" and said:
            mark, _, said = said.partition(" ")
            anchor = mark[1:] if mark[0] == "&" else anchor
            said = said.strip()
        if not said:
            put(None)
            pending = (indent, put, anchor, in_mapping)
            return
        if re.fullmatch(r"[|>][-+0-9]*", said):
            parts: list[str] = []
            put("")
            scalar = (indent, put, parts)
            return
        found = anchors.get(said[1:]) if said[0] == "*" else _flow(said, no, anchors) if said[0] in "[{" else _bare(said)
        if anchor:
            anchors[anchor] = found
        put(found)

    for no, raw in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        indent = len(raw) - len(raw.lstrip(" "))
        if scalar:
            if not raw.strip() or indent > scalar[0]:
                scalar[2].append(raw.strip())
                continue
            scalar[1]("\n".join(scalar[2]).strip())
            scalar = None
        body = _without_comment(raw.strip())
        if not body or body in ("---", "...") or body[0] == "%":
            continue
        dashed = body == "-" or body.startswith("- ")
        if pending:
            at, put, anchor, in_mapping = pending
            pending = None
            if indent > at or (dashed and in_mapping and indent == at):
                new = [] if dashed else Mapping() if KEY.match(body) else None
                if new is None:
                    value(body, no, at, put, in_mapping)
                    continue
                put(new)
                if anchor:
                    anchors[anchor] = new
                frames.append([indent, new])
        while frames and (frames[-1][0] > indent or (frames[-1][0] == indent and isinstance(frames[-1][1], list) and not dashed)):
            frames.pop()
        if not frames:
            if holder:
                continue  # a second document
            new = [] if dashed else Mapping()
            holder.append(new)
            frames.append([indent, new])
        top = frames[-1][1]
        while dashed and isinstance(top, list):
            rest = body[1:].lstrip()
            inner = indent + len(body) - len(rest)
            dashed = rest == "-" or rest.startswith("- ")
            if dashed or (rest and KEY.match(rest)):
                new = [] if dashed else Mapping()
                top.append(new)
                frames.append([inner, new])
                top, body, indent = new, rest, inner
                continue
            top.append(None)
            value(rest, no, indent, lambda v, top=top, k=len(top) - 1: top.__setitem__(k, v), False)
            body = ""
        if body and isinstance(top, Mapping) and (m := KEY.match(body)):
            key = _bare(m[1])
            value((m[2] or "").strip(), no, indent, lambda v, top=top, key=key, no=no: top.put(key, v, no), True)
    if scalar:
        scalar[1]("\n".join(scalar[2]).strip())
    return holder[0] if holder else None


def _merged(node) -> dict:
    """A mapping's entries with those of its merge key below them."""
    if not isinstance(node, dict):
        return {}
    bases = node.get("<<")
    out: dict = {}
    for base in bases if isinstance(bases, list) else [bases]:
        if isinstance(base, dict) and base is not node:
            out.update({k: v for k, v in base.items() if k != "<<"})
    return out | {k: v for k, v in node.items() if k != "<<"}


def _names(value, *keys: str) -> list[str]:
    """Names of a scalar or a list, whose entries may be mappings that hold the name under one of the keys."""
    listed = value if isinstance(value, list) else [value]
    found = [next((x[k] for k in keys if isinstance(x.get(k), str)), None) if isinstance(x, dict) else x for x in listed]
    return list(dict.fromkeys(x for x in found if isinstance(x, str) and x))


def _count(value) -> int:
    return len(value) if isinstance(value, list) else int(bool(value))


def github(tree) -> list[Job]:
    jobs = tree.get("jobs") if isinstance(tree, Mapping) else None
    out = []
    for name, body in jobs.items() if isinstance(jobs, Mapping) else ():
        if isinstance(body, dict) or body is None:
            own = _merged(body)
            on = own.get("runs-on")
            out.append(Job(name, jobs.lines[name], ", ".join(_names(on)) if not isinstance(on, dict) else ", ".join(_names(on.get("labels") or on.get("group"))), _names(own.get("needs")), _count(own.get("steps"))))
    return out


def gitlab(tree) -> list[Job]:
    """Jobs with their templates filled in; one that names no needs waits for all jobs of the nearest stage before its own that has any."""
    if not isinstance(tree, Mapping):
        return []
    cache: dict[str, dict] = {}

    def filled(name: str, depth: int = 0) -> dict:
        if name not in cache:
            cache[name] = {}  # a template that leads back to itself adds nothing
            own, out = _merged(tree.get(name)), {}
            for base in _names(own.get("extends")) if depth < MOST_TEMPLATES else ():
                out.update(filled(base, depth + 1))
            cache[name] = out | own
        return cache[name]

    stages = [FIRST_STAGE, *(s for s in (_names(tree.get("stages")) or GITLAB_STAGES) if s not in (FIRST_STAGE, LAST_STAGE)), LAST_STAGE]
    default = _merged(tree.get("default"))
    named = [n for n, body in tree.items() if n not in GITLAB_KEYS and not n.startswith(".") and isinstance(body, dict)]
    jobs = {n: filled(n) for n in named}
    at = {n: stages.index(s) if (s := str(j.get("stage") or PLAIN_STAGE)) in stages else len(stages) for n, j in jobs.items()}
    out = []
    for n, j in jobs.items():
        if "needs" in j:
            needs = _names(j["needs"], "job")
        else:
            before = max((k for k in at.values() if k < at[n]), default=None)
            needs = [m for m in jobs if at[m] == before]
        image = j.get("image") or default.get("image") or tree.get("image")
        on = _names(j.get("tags") or default.get("tags")) or _names(image, "name")
        out.append(Job(n, tree.lines[n], ", ".join(on), needs, _count(j.get("script"))))
    return out


def azure(tree) -> list[Job]:
    """Jobs of all stages. One that depends on no other job of its stage waits for the jobs of the stages that its stage depends on: the one before, if it names none."""
    if not isinstance(tree, Mapping):
        return []
    pool = lambda node: ", ".join(_names(node.get("pool"), "vmImage", "name")) if isinstance(node, dict) else ""
    stages = tree.get("stages")
    if not isinstance(stages, list):
        stages = [tree] if "jobs" in tree or "steps" in tree else []
    out: list[Job] = []
    of_stage: dict[str, list[str]] = {}
    last: str | None = None
    for k, stage in enumerate(stages):
        if not isinstance(stage, Mapping):
            continue
        name = next((str(stage[x]) for x in ("stage", "template") if stage.get(x)), f"stage{k + 1}")
        waits = _names(stage["dependsOn"]) if "dependsOn" in stage else [last] if last else []
        before = [j for s in waits for j in of_stage.get(s, ())]
        made = []
        listed = stage.get("jobs")
        for job in listed if isinstance(listed, list) else [stage] if "steps" in stage or "template" in stage else []:
            if not isinstance(job, Mapping):
                continue
            kind = next((x for x in ("job", "deployment", "template") if job.get(x)), None)
            label = str(job[kind]) if kind else "job"
            needs = _names(job["dependsOn"]) if "dependsOn" in job and job is not stage else []
            steps = job.get("steps")
            if kind == "deployment":
                strategy = _merged(job.get("strategy"))
                steps = [s for how in strategy.values() if isinstance(how, dict) for phase in how.values() if isinstance(phase, dict) for s in phase.get("steps") or ()]
            line = job.lines[kind] if kind else min(job.lines.values(), default=1)
            made.append(Job(label, line, pool(job) or pool(stage) or pool(tree), needs or before, _count(steps)))
        of_stage[name] = [j.name for j in made]
        last = name
        out += made
    return out


def jobs_of(path: str, text: str) -> list[Job]:
    low = path.lower()
    tree = read(text)
    return gitlab(tree) if low.endswith(".gitlab-ci.yml") else azure(tree) if low.endswith("azure-pipelines.yml") else github(tree)
