"""The toy graph, and a nested-loop evaluator that shares no code with the engine."""

TOY = [
    tuple(x.split())
    for x in """<a> <knows> <b>;<b> <knows> <c>;<c> <knows> <a>;<a> <knows> <a>;<a> <type> <P>;<b> <type> <P>;<c> <type> <Q>;<b> <likes> <c>;
<a> <name> "A";<b> <name> "B";<c> <name> "A";<knows> <label> "knows\"""".replace("\n", "").split(";")
]


def evaluate(graph, patterns):
    """All bindings of a list of (s, p, o) whose variables begin with ``?``."""
    out = [{}]
    for pattern in patterns:
        step = []
        for row in out:
            for triple in set(graph):
                new = dict(row)
                for term, value in zip(pattern, triple):
                    if term.startswith("?"):
                        if new.setdefault(term, value) != value:
                            break
                    elif term != value:
                        break
                else:
                    step.append(new)
        out = step
    return out


def text_of(patterns):
    return " . ".join(" ".join(p) for p in patterns)


def solutions(graph, group):
    """All bindings of a group (patterns, [groups that are optional]), each compatible with what is bound so far."""
    patterns, optionals = group
    out = evaluate(graph, patterns)
    for g in optionals:
        right, step = solutions(graph, g), []
        for row in out:
            step += [row | r for r in right if all(row.get(k, v) == v for k, v in r.items())] or [row]
        out = step
    return out


def group_text(group):
    patterns, optionals = group
    return " . ".join([text_of(patterns)]) + "".join(f" OPTIONAL {{ {group_text(g)} }}" for g in optionals)
