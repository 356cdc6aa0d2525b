from cardloom.operators import dom as D

HTML = '<body><div class="top"><p>Menu</p></div><div id="m" class="story main"><h1>Winter boats</h1><div class="promo"><p>Buy</p></div><section><p data-x="1">Text of it.</p></section></div></body>'


def texts(nodes):
    return [n["text"] for n in nodes if n["text"]]


def test_selectors_cut_the_tree():
    got = D.captured_tree(HTML, "https://a.example/", None, (".story.main", "[["), (".promo", "div > .none"))
    assert texts(got) == ["Winter boats", "Text of it."] and got[0]["attrs"]["id"] == "m"
    assert all(n["parent"] < n["idx"] < n["subtree_end"] for n in got) and got[0]["subtree_end"] == len(got)


def test_combinators():
    tree = D.parse("<div id='m'><section><p data-x='12'>a</p></section></div>", "")
    at = tree.tag.index("p")
    assert D.matches(tree, at, "#m p") and D.matches(tree, at, "section > p") and not D.matches(tree, at, "#m > p") and D.matches(tree, at, "p[data-x^='1'], b") and not D.matches(tree, at, "p[data-x$='1']")


def test_title_box_and_limits():
    assert texts(D.captured_tree(HTML, "", "Winter boats | Site")) == ["Winter boats", "Buy", "Text of it."]
    assert len(D.captured_tree(HTML, "", max_nodes=3)) == 3 and max(n["depth"] for n in D.captured_tree(HTML, "", max_depth=1)) == 1
    assert D.captured_tree(None, "") == [] and D.captured_tree("&#99999999;x", "") == []
