"""Markup is read with few tokens, and as it is read token by token."""

from fixatlas.sources.html_tree import _TOKEN, raw_title, read_page


def cells(html):
    return [[(c["tag"], c["spaced"]) for c in r["cells"]] for t in read_page(html, ("tables",))["tables"] for r in t["rows"]]


def test_an_element_with_one_text_is_one_token():
    assert [m.group() for m in _TOKEN.finditer("<tr><td>a</td ><th x='>'>b</th></tr>")] == [
        "<tr>", "<td>a</td >", "<th x='>'>b</th>", "</tr>",
    ]
    assert raw_title("<head><title> a &amp; b</title>") == " a &amp; b"


def test_elements_with_one_text_are_read_like_others():
    table = "<table><tr>{}</tr></table>"
    assert cells(table.format("<td>a</TD><td>b</td x><td>c<td> d&amp;e&lt;</td>")) == [
        [("td", "a"), ("td", "b"), ("td", "c"), ("td", "d&e<")]
    ]
    assert cells(table.format("<td><br>x</br>y</td><td/>z</td><div style='display: inline'>q</div>")) == [
        [("td", "x y"), ("td", "")]
    ]
    assert cells(table.format("<td>1<td><i>2</i><b> 3</b><table><tr><td>4</td></tr></table></td>")) == [
        [("td", "1"), ("td", "2 3 [4]")]
    ]
    assert [h["spaced"] for h in read_page("<body>a</body><p>b</p><h2>c<p>d</p>", ("headings",))["headings"]] == ["b", "c", "d"]
