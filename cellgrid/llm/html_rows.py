"""Labelled pages for html_extract: the text of a block begins with ``+`` if it is main text, with ``-`` if not."""

LABELLED = (
    """<html><head><title>x</title></head><body><nav><ul><li><a href="/a">-Home</a></li><li><a href="/b">-News</a></li><li><a href="/c">-About us</a></li></ul></nav>
    <div class="ad">-Buy now and save, this week only.</div><article><h1>+A short title</h1><p>+The first paragraph of the story has a fair number of words in it, as they do.</p>
    <p>+Yes.</p><p>+One more line of the text, with <a href="/z">a link</a> in it, and then some words after the link.</p><p>+Released under a free license.</p></article>
    <footer>-&copy; 2024 example.com &middot; All rights reserved.</footer></body></html>""",
    """<body><header><h2>-Site name</h2><p>-The best news in town, since long ago and for ever more.</p></header><main><h1>+Long day</h1><p>+It was a long day, and nobody knew when it would end, or how.</p><h2>+Part two</h2>
    <p>+Then it ended.</p><ul><li>+first of the points in the list</li><li>+second point</li></ul></main><aside><h3>-Related</h3><p>-Ten things that you should know about days, and what they mean to us.</p></aside>
    <div id="footer">-Contact and imprint</div></body>""",
    """<body><div class="menu"><a href="/">-Start</a> <a href="/x">-Shop</a></div><div class="cookie-notice"><p>-We use cookies to make this site work well for you. By going on you agree to that.</p><button>-Accept</button></div>
    <div class="content"><h1>+On rivers</h1><p>+Rivers run from the hills to the sea, and some of them are long.</p><blockquote>+A river is never the same twice.</blockquote><p>+So it is said.</p></div>
    <div class="sidebar"><p>-Read more on rivers in our great archive of rivers and lakes, open all year.</p><ul><li><a href="/r">-Lakes</a></li></ul></div></body>""",
    """<body><article><header><h1>+Heading inside</h1><p>+A lead that says in one sentence what comes.</p></header><p>+Body text of the article follows here, with enough words to be sure of it.</p>
    <div class="advert">-Sponsored: try the new thing today, it is really very good.</div><p>+After the advert the text goes on for a while.</p><p>+End.</p>
    <section class="comments"><h2>-Comments</h2><div class="comment"><p>-I liked this a lot, thank you for writing it down for all of us.</p></div><div class="comment"><p>-Me too.</p></div></section></article>
    <form action="/s"><label>-Your mail</label><p>-Subscribe to our newsletter and get news each day.</p></form></body>""",
    """<body><div><p>+This page has no marks at all, but its paragraphs are long and end like sentences do.</p><p>+A second paragraph of the same kind follows, and it has many words too, as one would expect.</p><p>+Short one.</p></div>
    <div><a href="/1">-Next</a> <a href="/2">-Previous</a></div><div class="share"><a href="/t">-Tweet this</a></div><p class="copyright">-Copyright by us.</p></body>""",
    """<body><div role="navigation"><a href="/q">-Questions</a></div><div class="post"><h1>+What to do</h1><p>+Do this first, and then do that, and be done with it by noon.</p><pre>+some code = 1</pre><table><tr><td>+cell one</td><td>+cell two</td></tr></table></div>
    <div id="comments"><p>-First! I was here before everybody else, and I am proud of it.</p><p>-Nice post.</p></div><div class="popup"><p>-Sign up now to read on, it takes no time at all.</p></div></body>""",
    """<body><div class="header"><p>-The town paper, every day since long ago.</p></div><div class="topmenu menu"><a href="/">-Front</a></div><div class="box"><h1>+A plain page</h1><p>+This text stands in a box that has no name to speak of, as many texts do.</p><p>+No.</p>
    <p>+It goes on for a line or two, and then it is over.</p></div><div class="comments"><p>-That was a good read, I have to say, and I mean it.</p><p>-Agreed.</p></div><div class="notice"><p>-This site uses cookies, and you have been told so.</p></div><div class="footer"><p>-Imprint and contact, for whom it may concern.</p></div></body>""",
    """<body><header><p>-Our site, the best of all the sites that we know of.</p></header><nav><a href="/n">-News</a><p>-Find your way around here.</p></nav><h1>+Bare text</h1><p>+The text of this page lies in the body itself, and in nothing else.</p><p>+Good.</p><h2>+More of it</h2>
    <p>+A second part has its own heading, and a few words of its own.</p><aside><p>-An aside tells you what others have read, which is not the text.</p></aside><section id="comments"><h3>-Replies</h3><p>-I read it twice, and liked it twice as much.</p></section>
    <form><p>-Leave your words here, and we will look at them.</p></form><footer><p>-Made by hand in a house by the sea, with love.</p></footer></body>""",
    """<body class="home has-sidebar"><div class="wrap with-sidebar"><div class="post-content"><h1>+Of ships</h1><p>+Ships are large, and boats are small; both of them float on water.</p><div class="newsletter-signup"><p>-Get our letter each week, it is free and it is good.</p></div>
    <p>+Some sink.</p><h2>+Harbours</h2><p>+In a harbour ships find rest from wind and waves, and so do we.</p><div class="share-links"><a href="/f">-Share</a></div></div><div class="sidebar"><h3>-Popular</h3><p>-What you never knew about ships, in ten pictures and few words.</p></div></div>
    <div class="footer"><p>-All rights are reserved by the owners of this site.</p></div></body>""",
    """<body><section class="notice"><p>-This site will be down for some hours on Sunday, we are sorry for that.</p></section><article><h1>+Plain words</h1><p>+Words.</p><p>+More words in a line that is not so short.</p><p>+And</p><p>+Some</p></article>
    <nav class="pagination"><a href="/2">-2</a></nav><div class="banner"><p>-The sale ends today. Do not miss it, it is great.</p></div><footer><p>-Made with care in a small town by people who like the web.</p></footer></body>""",
)
