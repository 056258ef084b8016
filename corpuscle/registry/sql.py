"""Composition of reference SQL: named views, pulled in by the statements that mention them."""

import re

VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> str:
    """Name a view; any statement built with `select` may read it."""
    VIEWS[name] = body.strip()
    return name


def select(body: str) -> str:
    """A statement with every view it needs, in order, in a WITH clause."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[vr]_\w+", text):
            if name in VIEWS and name not in order:
                need(re.sub(rf"\b{name}\b", "", VIEWS[name]))
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body.strip()
    views = ",\n".join(f"{name} AS (\n{VIEWS[name]}\n)" for name in order)
    return f"WITH RECURSIVE {views}\n{body.strip()}"
