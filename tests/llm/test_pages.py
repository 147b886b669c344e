"""Main text of pages without article tags, beside all that is not main text."""

import re

import pytest

from maskfold.llm import html_extract, labelled_pages


def words(word, n):
    return " ".join([word] * n)


STORY = f"<div><h1>Title</h1><p>{words('main', 60)}</p><p>{words('main', 70)}</p><p>End.</p></div>"
KEPT = ["Title", words("main", 60), words("main", 70), "End."]
BESIDE = {
    "footer": f"<footer>{words('x', 60)}</footer>", "aside": f"<aside>{words('x', 60)}</aside>", "nav": f"<nav>{words('x', 60)}</nav>", "notice": f"<div class='cookie-notice'>{words('x', 60)}</div>",
    "form": f"<form>{words('x', 60)}</form>", "comments": f"<div id='comments'><p>{words('x', 60)}</p></div>", "links": "<div>" + " ".join("<a href='/'>x x</a>" for _ in range(20)) + "</div>",
    "link around a block": f"<a href='/'><div>{words('x', 40)}</div></a>", "respond": f"<div id='respond' class='comment-respond'>{words('x', 60)}</div>", "hidden": f"<div style='color:red; display: none'>{words('x', 60)}</div>",
    "disclaimer": f"<p class='disclaimer'>{words('x', 40)}</p>", "subscribe": f"<div class='subscribe-box'>{words('x', 30)}</div>", "item": "<ul><li class='ad'><div>x x</div><p>x</p></li></ul>",
}


@pytest.mark.parametrize("name", BESIDE)
@pytest.mark.parametrize("page", ["{story}{other}", "{other}{story}", "<main>{story}{other}</main>", "<body><nav><ul><li><a href=/>Home</a></li></ul></nav>{story}{other}<footer>x</footer></body>"])
def test_what_stands_beside_a_story_goes(name, page):
    assert html_extract.main_text(page.format(story=STORY, other=BESIDE[name])).split("\n") == KEPT


def test_what_follows_an_item_or_an_open_link_stays():
    marked = f"<ul><li class='ad'>x x<li>{words('main', 40)}</ul><p class='ad'>x<p>{words('main', 50)}</p>"
    assert html_extract.main_text(f"<div>{marked}</div>").split("\n") == [words("main", 40), words("main", 50)]
    unclosed = f"<p><a href='/'>see here {words('main', 50)}<p>{words('main', 60)}</p>"
    assert html_extract.main_text(unclosed).split("\n")[-1] == words("main", 60)


def test_link_density_decides():
    x, y = html_extract.labelled()
    tree, used = html_extract.tree(), 0
    for row in x:
        node, seen = tree, set()
        while node.feature >= 0:
            seen.add(html_extract.FEATURES[node.feature])
            node = node.low if row[node.feature] <= node.limit else node.high
        used += bool({"links", "links_before", "links_after", "links_around"} & seen)
    assert used > 0.9 * len(x)
    assert sum(html_extract.says(tree, row) != label for row, label in zip(x, y, strict=True)) < 0.01 * len(y)


def test_tree_holds_on_pages_it_has_not_seen():
    """Blocks of pages of other lengths than those the tree was grown on."""
    wrong = total = 0
    for seed in range(100, 108):
        for page in labelled_pages._open(labelled_pages.Sizes(seed)):
            found = html_extract.blocks(page)
            for b, row in zip(found, html_extract.features(found), strict=True):
                wrong += html_extract.says(html_extract.tree(), row) != (labelled_pages.MAIN in b.text)
                total += 1
    assert wrong < 0.03 * total


def test_given_pages_without_their_article_tags(spark, small):
    same = total = 0
    for (page,) in spark.read.parquet(f"{small}/pages.parquet").select("html").collect():
        tagged = html_extract.main_text(page).split("\n")
        plain = html_extract.main_text(re.sub(r"<(/?)(?:article|main)>", r"<\1div>", page or "")).split("\n")
        same += len([t for t in tagged if t in plain]) - len([t for t in plain if t not in tagged])
        total += len(tagged)
    assert same >= 0.95 * total
