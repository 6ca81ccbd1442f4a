"""A service of three pages, for the paged source."""

PAGES = {"*": (["a", "b"], "c2"), "c2": (["c"], "c3"), "c3": (["d"], None)}


def fetch(url: str) -> dict:
    cursor = url.split("cursor=")[1].split("&")[0].replace("%2A", "*")
    rows, nxt = PAGES[cursor]
    return {"results": [{"id": r} for r in rows], "meta": {"next_cursor": nxt}}
