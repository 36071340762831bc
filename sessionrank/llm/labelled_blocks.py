"""A small labelled table of text blocks: pages written for it, with a 1 for each block of the article and a 0 for each other."""

_LONG = (
    "The council voted on Tuesday to repair the old bridge over the river, which has been closed to heavy traffic since the floods of last"
    " spring. Engineers had warned that two of its pillars were no longer safe, and that a repair would cost less than a new one."
)
_MID = "Work begins in May and should take eleven weeks, the mayor said, adding that buses will use the northern road meanwhile."
_SHORT = "Nobody was hurt."
_LINKED = 'As <a href="/r/1">an earlier report</a> found, the pillars had not been looked at for more than twenty years, although the law asks for it.'
_MANY = 'Others are <a href="/p">the old mill bridge</a>, <a href="/q">the railway bridge in the north</a> and <a href="/s">the ferry at the lower town</a>.'
_MENU = '<li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport and leisure</a></li>'
_FOOT = "&copy; 2021 The Daily River &middot; All rights reserved"
_ASIDE = '<h3>Most read</h3><ul><li><a href="/1">Ten ways to cook a river trout at home</a></li><li><a href="/2">Ferry strike goes on</a></li></ul>'
_COMMENT = "<p>I have said for years that the bridge is dangerous, and nobody at the town hall ever wanted to listen to us who live here.</p>"

PAGES = [
    # an article among named parts
    (
        f"<title>Bridge</title><body><nav><ul>{_MENU}</ul></nav><div class='ad'>Cheap flights to the sun, book by Friday.</div><article><h1>Bridge to be repaired</h1>"
        f"<p>{_LONG}</p><p>{_SHORT}</p><p>{_LINKED}</p><p>Yes.</p><p>{_MID}</p></article><footer>{_FOOT}</footer></body>",
        "0 0 0 0 1 1 1 1 1 1 0",
    ),
    (
        f"<body><header><a href='/'>The Daily River</a><p>News for the whole valley since 1887</p></header><main><h1>Bridge</h1><p>{_MID}</p><h2>Costs</h2><p>{_LONG}</p>"
        f"<ul><li>Two new pillars</li><li>A wider path for cycles</li></ul></main><aside>{_ASIDE}</aside><footer><p>{_FOOT}</p><a href='/i'>Imprint</a></footer></body>",
        "0 0 1 1 1 1 1 1 0 0 0 0 0",
    ),
    (
        f"<div class='cookie-notice'>We use cookies to make this site better for you. Read how we handle them in our policy.</div><article><header><h1>Bridge</h1></header><p>{_LONG}</p>"
        f"<div class='advert'>Our partner's shoes are half the price this week, only while stocks last.</div><p>{_MID}</p><p>{_SHORT}</p></article>"
        f"<section id='comments'><h3>3 comments</h3><article class='comment'>{_COMMENT}</article><article><p>Well said!</p></article></section>",
        "0 1 1 0 1 1 0 0 0",
    ),
    (
        f"<form action='/login'><p>Log in to read your saved pages</p><label>Name</label></form><article><p>{_MID}</p><p>Short.</p><blockquote>{_LONG}</blockquote></article>"
        f"<div>Related stories from around the valley</div><div><a href='/x'>Trout season opens</a></div><div>{_FOOT}</div>",
        "0 0 1 1 1 0 0 0",
    ),
    (
        f"<article><p>{_SHORT}</p><p><a href='/more'>Read all about the floods of last spring</a></p><p>{_LONG}</p><h2><a href='#c'>Costs</a></h2><p>{_LINKED}</p></article><footer><p>{_LONG}</p></footer>",
        "1 0 1 1 1 0",
    ),
    (f"<nav><a href='/'>Home</a></nav><article><p>Be.</p></article><aside><p>{_LONG}</p><p>{_MID}</p></aside>", "0 1 0 0"),
    (f"<article><h1>Only a title</h1></article><div>Contact us by post or by telephone on every working day</div><p>{_MID}</p>", "1 0 0"),
    (f"<main><p>{_MID}</p><p>{_LINKED}</p></main><p>Opening hours</p><p>Monday to Friday, from nine to five</p><p>{_LONG}</p>", "1 1 0 0 0"),
    # long texts around an article
    (
        f"<header><p>{_LONG}</p><p>{_LONG}</p><p>{_MID}</p></header><article><p>{_MID}</p><p>{_LONG}</p><p>{_LONG}</p></article><section class='comments'><p>{_LONG}</p>{_COMMENT}{_COMMENT}"
        f"<p>{_LONG}</p><p>{_SHORT}</p></section><footer><p>{_LONG}</p><p>{_MID}</p><p>{_LONG}</p></footer>",
        "0 0 0 1 1 1 0 0 0 0 0 0 0 0",
    ),
    (
        f"<div class='consent'><p>{_LONG}</p><p>{_LONG}</p><p>{_MID}</p></div><p>{_LONG}</p><p>{_SHORT}</p><p>{_LONG}</p><div class='sidebar'><p>{_LONG}</p><p>{_LONG}</p><p>{_SHORT}</p></div>",
        "0 0 0 1 1 1 0 0 0",
    ),
    (
        f"<aside><p>{_LONG}</p><p>{_LINKED}</p><p>{_LONG}</p></aside><div id='content'><p>{_LONG}</p><p>Oh.</p></div><form><p>{_LONG}</p><p>{_LONG}</p><p>{_MID}</p></form>",
        "0 0 0 1 1 0 0 0",
    ),
    (
        f"<div id='main'><h1>Bridge</h1><p>{_LONG}</p></div><div class='ad'><p>{_LONG}</p><p>{_LONG}</p></div><div><p>{_LONG}</p><p>{_LONG}</p><p>{_MID}</p></div>",
        "1 1 0 0 0 0 0",
    ),
    (f"<article><h1><a href='/b'>Bridge</a></h1><p>{_MID}</p><h2><a href='#c'>Costs</a></h2><p>No.</p></article><div><p>{_LONG}</p><p>{_LONG}</p></div>", "1 1 1 1 0 0"),
    (f"<article><h2><a href='#d'>Dates</a></h2><p>May.</p><ul><li>Steel</li><li>Stone</li><li>Time</li></ul><p><a href='/y'>Buy the paper</a></p></article><nav><p>{_LONG}</p><p>{_LONG}</p></nav>", "1 1 1 1 1 0 0 0"),
    (f"<div class='story'><p>{_MID}</p><ul><li>Steel</li><li>Stone</li></ul><p>Ah.</p></div><div class='widget'><p>{_LONG}</p><p>{_LONG}</p></div>", "1 1 1 1 0 0"),
    # links and legal lines inside an article
    (f"<article><p>{_MANY}</p><p>{_LONG}</p><p>All rights reserved.</p></article><div>{_FOOT}</div>", "1 1 1 0"),
    (f"<article><p>Copyright 2021 by the bridge engineers.</p><p>{_MANY}</p><p>{_SHORT}</p></article><div class='ad'>{_MANY}</div>", "1 1 1 0"),
    (f"<div id='content'><p>{_LONG}</p><p>{_MANY}</p><p>(c) the author. All rights reserved.</p></div><ul>{_MENU}</ul><div>{_FOOT}</div>", "1 1 1 0 0 0 0"),
    (f"<article><h1>***</h1><p>{_MANY}</p><p>--</p></article>", "1 1 1"),
    (f"<article><p>{_LONG}</p><p>All rights reserved. No part of this text may be printed again without asking its author first.</p></article>", "1 1"),
    (f"<article><h1>Bridge</h1><p>(c) 2021 by the author of this report, who has asked us not to name them.</p><p>{_MID}</p></article><footer>{_FOOT}</footer>", "1 1 1 0"),
    (f"<div class='story'><p>{_MID}</p><p>Copyright lies with the town, and copies may be made for schools and for reading aloud.</p></div><div>{_FOOT}</div>", "1 1 0"),
    (f"<main><p>Copyright was the first thing that the engineers asked about, the mayor said.</p><p>{_SHORT}</p></main>", "1 1"),
    (f"<p>{_LONG}</p><p>{_FOOT}</p>", "1 0"),
    (f"<div><p>{_LONG}</p><p>{_MID}</p></div><p>Copyright Valley Press Limited</p>", "1 1 0"),
    # parts that only class or id names
    (
        f"<div id='top-menu'><a href='/'>Home</a> <a href='/n'>News</a></div><div id='content'><h1>Bridge</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_LINKED}</p></div>"
        f"<div id='sidebar'><p>{_MID}</p>{_ASIDE}</div><div class='footer'>{_FOOT}</div>",
        "0 1 1 1 1 0 0 0 0 0",
    ),
    (
        f"<div class='post'><h2>Bridge</h2><p>{_MID}</p><p>Hm.</p><p>{_LONG}</p></div><div class='comments'>{_COMMENT}{_COMMENT}</div><div class='newsletter'>Get our letter every Monday morning</div><p>Imprint</p>",
        "1 1 1 1 0 0 0 0",
    ),
    (f"<div class='entry-content'><p>{_LONG}</p><p><a href='/n'>Next page of this story</a></p></div><div>Weather: rain in the north</div><div><a href='/w'>More weather</a></div>", "1 0 0 0"),
    # nothing named
    (
        f"<body><div><a href='/'>Home</a> | <a href='/n'>News</a> | <a href='/s'>Sport</a></div><div><h1>Bridge to be repaired</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MID}</p><p>{_LINKED}</p></div>"
        f"<div><a href='/1'>Ferry strike goes on</a></div><div><a href='/2'>Ten ways to cook a trout</a></div><div>{_FOOT}</div></body>",
        "0 1 1 1 1 1 0 0 0",
    ),
    (f"<h1>Bridge to be repaired</h1><p>{_LONG}</p><p>{_MID}</p>", "1 1 1"),
    (f"<p>{_SHORT}</p><p>{_LONG}</p><p>Yes.</p><p>{_LINKED}</p><p>{_SHORT}</p>", "1 1 1 1 1"),
    (_LONG, "1"),
    (_SHORT, "1"),
    (f"<p>{_MID}</p>", "1"),
    (
        f"<table><tr><td><a href='/'>Home</a></td></tr><tr><td><a href='/n'>News</a></td></tr></table><div><p>{_MID}</p><p>{_SHORT}</p><p>{_LONG}</p></div><ul>{_MENU}</ul>",
        "0 0 1 1 1 0 0 0",
    ),
    (f"<ul>{_MENU}</ul><h1>Bridge</h1><p>{_LONG}</p><ul><li>Two new pillars made of steel and stone</li><li>A wider path</li></ul><p>{_MID}</p><p>{_FOOT}</p>", "0 0 0 1 1 1 1 1 0"),
    (f"<div><a href='/l'>Log in</a></div><div>Menu</div><div><p>{_LONG}</p><p>{_MID}</p></div><div>Share this</div><div><a href='/f'>Friends</a> <a href='/t'>Mail</a></div><div>{_FOOT}</div>", "0 0 1 1 0 0 0"),
    (f"<div><a href='/1'>One long headline of another story of the day</a></div><div><a href='/2'>And one more headline about the ferry</a></div><div>{_FOOT}</div>", "0 0 0"),
    (f"<ul>{_MENU}</ul>", "0 0 0"),
    ("<article><h1>桥梁将被修复</h1><p>市议会星期二投票决定修复河上的旧桥，自去年春天洪水以来该桥一直禁止重型车辆通行。</p></article><div><a href='/'>首页</a></div><footer>联系我们</footer>", "1 1 0 0"),
]
