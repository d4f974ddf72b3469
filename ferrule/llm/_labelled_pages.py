"""Labelled pages: the main text of each stands between <!--main--> and <!--/main-->."""

WORDS = "the old mill by the river was built when grain still came down on barges and the town had two bridges".split()

# Names that stand for something else than main text, for main text, and for neither.
PURPOSE = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert newsletter subscribe subscription signup nav navbar navigation navigations menu menus "
    "sidebar sidebars breadcrumb breadcrumbs header footer foot comment comments reply replies respond disqus share sharing social related recommended popup modal overlay login search toolbar pagination pager copyright "
    "complementary contentinfo masthead skip widget widgets topbar"
).split()
CONTENT = "content article post entry story text body main prose chapter document".split()
NEITHER = "box block list area section wrapper wrap container inner outer top bottom left right item items group row col column slot unit panel site page user reader global primary secondary bar links form title thread footer1 js ui the 1 2 3 4 5".split()


def _text(n: int, at: int = 0) -> str:
    return " ".join(WORDS[(at + i) % len(WORDS)] for i in range(n))


def _links(n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_text(1 + i % 3, i)}</a></li>' for i in range(n))


def _paragraphs(n: int, size: int) -> str:
    return "".join(f"<p>{_text(size + 3 * i, i)}, <em>{_text(2, i)}</em> {_text(4)} <a href='#'>{_text(2)}</a>.</p>" for i in range(n))


def pages() -> list[str]:
    """Layouts with and without elements that name their purpose."""
    out = []
    for n, size in ((2, 12), (5, 30), (9, 45)):
        main = f"<!--main--><h1>{_text(6)}</h1>{_paragraphs(n, size)}<h2>{_text(3)}</h2>{_paragraphs(n, size)}<ul><li>{_text(8)}</li><li>{_text(9)}</li></ul><blockquote>{_text(15)}</blockquote><!--/main-->"
        out += [
            f"<html><head><title>{_text(4)}</title></head><body><header><a href='/'>{_text(2)}</a></header><nav><ul>{_links(8)}</ul></nav><article>{main}</article><aside><ul>{_links(6)}</ul></aside><footer>{_text(9)}</footer></body></html>",
            f"<body><div><ul>{_links(12)}</ul></div><div><div>{main}</div></div><div><h3>{_text(2)}</h3><ul>{_links(9)}</ul></div><div><a href='#'>{_text(2)}</a> | <a href='#'>{_text(1)}</a> | {_text(3)}</div></body>",
            f"<body><table><tr><td><a href='/'>{_text(1)}</a></td><td><a href='/'>{_text(2)}</a></td></tr></table><div>{main}</div><form><label>{_text(2)}</label><input><button>{_text(1)}</button></form><table><tr><td>{_text(2)}</td><td>{_text(1)}</td></tr></table></body>",
            f"<body><div class='menu'>{_links(5)}</div><div class='content'>{main}</div><div class='comments'><div><b>{_text(1)}</b><span>{_text(2)}</span><p>{_text(7)}</p></div></div></body>",
        ]
    for i, name in enumerate(PURPOSE):
        near, far = NEITHER[i % len(NEITHER)], NEITHER[(7 * i + 3) % len(NEITHER)]
        own = CONTENT[i % len(CONTENT)]
        main = f"<!--main--><h1>{_text(6)}</h1><div class='{near} {far}'>{_paragraphs(2, 14)}</div><!--/main-->"
        out.append(f"<body><div class='{name}'>{_links(4)}</div><div class='{own} {own}-{near}'>{main}</div><div class='{name}-{far} {near}'><p>{_text(5)}</p></div><div id='{name}'>{_links(2)}</div></body>")
    return out
