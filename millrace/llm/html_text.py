"""HTML main-text extraction: flat text blocks, classified by a decision tree on their own and their neighbours' features.

A page is read once, from left to right, and cut into flat blocks at its block-level tags; the items of a list count as one. A block has a number of words and a
link density (the share of its words inside links); so have its neighbours, the three blocks before and the three after it, of which the longest counts; and it has
a share of the page's longest block. Besides, markup may say that a block lies in the article, that it is a heading or a list, and how surely
it lies in a part that is no article: an element like nav or footer, a name that ends like that of such a part (`sidebar`, `post-comments`), or a name that only
holds such a word (`tags-explained`), which counts for little. Blocks of the surer kinds are nobody's neighbours. These features go through a
decision tree, grown by Gini impurity from the small table below, whose blocks were labelled one by one; blocks it accepts are the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import in_slices, small_batches

# HTML element names by their role, and words in class, id and role that name a part which is no article.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow mroot ms msqrt msub msubsup msup mtext munder mover q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video select".split())
APART = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl".split())
APART_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: Words that a part's name may end in without saying anything.
PLAIN_WORDS = frozenset("area bar block box container content holder inner item items list outer panel row section slot unit wrap wrapper".split())
#: Words beside which `header`, `related` and the like are part of the article's own names.
OWN_WORDS = frozenset("article body chapter content entry post section story text title work works".split())

#: How surely a block lies in a part that is no article: a name holds such a word, a name ends in one, an element or attribute says so; and the last, but for headings.
WEAK, STRONG, SURE, BUT_HEADINGS = 1, 2, 3, 4
#: The features of a block, as the tree sees them. Before and after: the words of the longest of three blocks, and the share of links in all three.
FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "heading", "apart", "in article", "page has article", "list", "share of longest")
#: Blocks labelled one by one: the features up to the last but two, and 1 for main text. None of these is a list. Apart is 1 for STRONG here.
LABELLED = [
    # no article named: paragraphs and list items, long ones and short ones near them
    (60, 0, 50, 0, 70, 0, 0, 0, 0, 0, 1), (25, 0.1, 30, 0, 0, 0, 0, 0, 0, 0, 1), (14, 0, 40, 0, 30, 0, 0, 0, 0, 0, 1), (90, 0.2, 0, 0, 4, 1, 0, 0, 0, 0, 1), (18, 0, 5, 0, 25, 0, 0, 0, 0, 0, 1), (12, 0, 12, 0, 12, 0, 0, 0, 0, 0, 1), (40, 0.25, 12, 0, 3, 1, 0, 0, 0, 0, 1),
    (30, 0, 2, 1, 6, 0, 0, 0, 0, 0, 1), (11, 0, 3, 1, 20, 0, 0, 0, 0, 0, 1), (70, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1), (16, 0.1, 0, 0, 14, 0, 0, 0, 0, 0, 1), (17, 0, 4, 0, 2, 0, 0, 0, 0, 0, 1), (12, 0, 5, 0, 4, 0, 0, 0, 0, 0, 1), (15, 0, 1, 1, 3, 0, 0, 0, 0, 0, 1), (20, 0, 0, 0, 1, 1, 0, 0, 0, 0, 1),
    (11, 0, 2, 0, 2, 0, 0, 0, 0, 0, 1), (13, 0.1, 60, 0, 0, 0, 0, 0, 0, 0, 1), (22, 0.3, 28, 0, 20, 0, 0, 0, 0, 0, 1), (14, 0, 3, 0.3, 9, 0, 0, 0, 0, 0, 1), (2, 0, 40, 0, 40, 0, 0, 0, 0, 0, 1), (4, 0, 17, 0, 20, 0, 0, 0, 0, 0, 1), (3, 0, 12, 0, 15, 0, 0, 0, 0, 0, 1),
    (9, 0, 30, 0, 18, 0, 0, 0, 0, 0, 1), (5, 0, 25, 0, 30, 0.1, 0, 0, 0, 0, 1), (1, 0, 15, 0, 90, 0, 0, 0, 0, 0, 1), (8, 0, 60, 0, 14, 0, 0, 0, 0, 0, 1), (6, 0, 16, 0, 50, 0, 0, 0, 0, 0, 1), (3, 0, 70, 0, 5, 0, 0, 0, 0, 0, 1), (8, 0, 25, 0, 2, 0, 0, 0, 0, 0, 1), (9, 0, 12, 0, 0, 0, 0, 0, 0, 0, 1),
    (6, 0, 60, 0, 0, 0, 0, 0, 0, 0, 1), (5, 0, 6, 0, 28, 0, 0, 0, 0, 0, 1), (7, 0, 2, 0, 40, 0, 0, 0, 0, 0, 1), (5, 0.1, 35, 0.05, 22, 0, 0, 0, 0, 0, 1), (2, 0, 17, 0, 2, 1, 0, 0, 0, 0, 1), (5, 0, 30, 0, 3, 1, 0, 0, 0, 0, 1), (6, 0, 45, 0, 6, 1, 0, 0, 0, 0, 1),
    # their headings
    (5, 0, 3, 1, 60, 0, 1, 0, 0, 0, 1), (8, 0, 40, 0, 30, 0, 1, 0, 0, 0, 1), (3, 0, 25, 0, 15, 0, 1, 0, 0, 0, 1), (6, 0, 0, 0, 40, 0, 1, 0, 0, 0, 1), (9, 0, 2, 1, 11, 0, 1, 0, 0, 0, 1), (4, 0, 1, 1, 17, 0, 1, 0, 0, 0, 1), (3, 0, 3, 1, 20, 0, 1, 0, 0, 0, 1), (2, 0, 4, 0, 25, 0, 1, 0, 0, 0, 1),
    (4, 0, 0, 0, 4, 1, 1, 0, 0, 0, 0), (3, 0, 4, 0, 3, 1, 1, 0, 0, 0, 0), (2, 0, 3, 0, 5, 0, 1, 0, 0, 0, 0), (3, 0, 40, 0, 3, 1, 1, 0, 0, 0, 0),
    # menus, captions, notes and other short or linked blocks
    (3, 1, 3, 1, 3, 1, 0, 0, 0, 0, 0), (1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 0), (20, 0.9, 15, 0.8, 30, 0, 0, 0, 0, 0, 0), (14, 0.6, 30, 0, 12, 0.7, 0, 0, 0, 0, 0), (40, 0.5, 4, 1, 60, 0, 0, 0, 0, 0, 0), (5, 0.6, 40, 0, 40, 0, 0, 0, 0, 0, 0), (12, 0.7, 50, 0, 50, 0, 0, 0, 0, 0, 0), (9, 0, 2, 0, 2, 0, 0, 0, 0, 0, 0),
    (8, 0, 3, 1, 3, 1, 0, 0, 0, 0, 0), (7, 0, 5, 0, 4, 0, 0, 0, 0, 0, 0), (4, 0, 3, 1, 5, 0, 0, 0, 0, 0, 0), (2, 0, 2, 0, 2, 0, 0, 0, 0, 0, 0), (5, 0, 3, 1, 6, 1, 0, 0, 0, 0, 0), (3, 0, 30, 0.7, 3, 1, 0, 0, 0, 0, 0), (6, 0, 20, 0.8, 0, 0, 0, 0, 0, 0, 0), (2, 1, 60, 0, 0, 0, 0, 0, 0, 0, 0), (4, 1, 50, 0.1, 45, 0, 0, 0, 0, 0, 0),
    # in an article that markup names: whatever its length
    (60, 0, 50, 0, 70, 0, 0, 0, 1, 1, 1), (1, 0, 2, 0, 40, 0, 0, 0, 1, 1, 1), (2, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1), (7, 0, 3, 0, 4, 0, 0, 0, 1, 1, 1), (9, 0, 2, 1, 0, 0, 0, 0, 1, 1, 1), (4, 0.5, 30, 0, 0, 0, 0, 0, 1, 1, 1), (6, 1, 40, 0.1, 30, 0, 0, 0, 1, 1, 1), (3, 1, 25, 0, 0, 0, 0, 0, 1, 1, 1), (12, 0.8, 20, 0, 15, 0.3, 0, 0, 1, 1, 1),
    (5, 0, 0, 0, 60, 0, 1, 0, 1, 1, 1), (3, 0, 2, 0, 2, 0, 1, 0, 1, 1, 1), (8, 1, 0, 0, 50, 0, 1, 0, 1, 1, 1), (2, 0, 70, 0, 0, 0, 1, 0, 1, 1, 1), (30, 0.4, 4, 0.9, 4, 0.9, 0, 0, 1, 1, 1), (18, 0, 3, 1, 3, 1, 0, 0, 1, 1, 1), (5, 0, 4, 1, 3, 1, 0, 0, 1, 1, 1), (11, 0.1, 0, 0, 0, 0, 0, 0, 1, 1, 1),
    (3, 1, 4, 1, 5, 1, 0, 0, 1, 1, 1), (6, 1, 5, 1, 6, 1, 0, 0, 1, 1, 1), (2, 1, 2, 1, 3, 1, 0, 0, 1, 1, 1), (9, 1, 8, 0.95, 7, 1, 0, 0, 1, 1, 1), (2, 1, 4, 0, 17, 0, 0, 0, 1, 1, 1), (3, 1, 6, 0.2, 20, 0, 0, 0, 1, 1, 1), (4, 1, 2, 0, 0, 0, 0, 0, 1, 1, 1),
    (1, 0, 20, 0, 2, 1, 0, 0, 1, 1, 1), (3, 0, 5, 0, 2, 1, 0, 0, 1, 1, 1), (4, 0, 30, 0, 3, 1, 0, 0, 1, 1, 1), (1, 0, 1, 0, 2, 1, 0, 0, 1, 1, 1), (3, 0, 4, 1, 0, 0, 0, 0, 1, 1, 1), (2, 0, 3, 1, 20, 0, 0, 0, 1, 1, 1), (6, 0, 2, 1, 5, 0, 0, 0, 1, 1, 1), (2, 0, 4, 1, 4, 1, 0, 0, 1, 1, 1),
    # beside such an article
    (50, 0, 30, 0, 60, 0, 0, 0, 0, 1, 0), (12, 0.1, 0, 0, 25, 0, 0, 0, 0, 1, 0), (3, 1, 3, 1, 3, 1, 0, 0, 0, 1, 0), (7, 0, 40, 0, 0, 0, 0, 0, 0, 1, 0), (4, 0, 0, 0, 50, 0, 1, 0, 0, 1, 0), (25, 0, 2, 1, 3, 0, 0, 0, 0, 1, 0), (2, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0),
    (17, 0, 4, 0.3, 0, 0, 0, 0, 0, 1, 0), (20, 0, 10, 0, 0, 0, 0, 0, 0, 1, 0), (14, 0, 50, 0, 12, 0, 0, 0, 0, 1, 0), (60, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0), (11, 0, 12, 0, 5, 0, 0, 0, 0, 1, 0), (16, 0, 30, 0, 14, 0, 0, 0, 0, 1, 0), (30, 0, 60, 0, 30, 0, 0, 0, 0, 1, 0), (6, 0, 25, 0, 30, 0, 1, 0, 0, 1, 0), (3, 0, 20, 0, 40, 0, 0, 0, 0, 1, 0), (90, 0.1, 20, 0.1, 0, 0, 0, 0, 0, 1, 0),
    # in a part that markup names as none, wherever that is
    (40, 0, 50, 0, 30, 0, 0, 1, 0, 0, 0), (15, 0, 0, 0, 60, 0, 0, 1, 0, 0, 0), (70, 0, 60, 0, 0, 0, 0, 1, 1, 1, 0), (12, 0.1, 25, 0, 30, 0, 0, 1, 1, 1, 0), (5, 0, 40, 0, 40, 0, 1, 1, 0, 0, 0), (3, 0, 20, 0, 20, 0, 1, 1, 1, 1, 0), (30, 0, 30, 0, 0, 0, 0, 1, 0, 1, 0), (8, 0, 90, 0, 12, 0, 0, 1, 0, 0, 0), (2, 1, 0, 0, 50, 0, 0, 1, 0, 1, 0),
]


#: Further blocks, with all features.
LABELLED_TOO = [
    # lists as a whole, without an article: items among text, and menus
    (7, 0, 30, 0, 25, 0, 0, 0, 0, 0, 1, 0.2, 1), (40, 0, 20, 0, 30, 0, 0, 0, 0, 0, 1, 1, 1), (14, 0.1, 15, 0, 0, 0, 0, 0, 0, 0, 1, 0.8, 1), (60, 0.2, 6, 0, 12, 0, 0, 0, 0, 0, 1, 1, 1), (9, 0, 18, 0, 6, 0, 0, 0, 0, 0, 1, 0.5, 1), (5, 0, 60, 0, 40, 0, 0, 0, 0, 0, 1, 0.1, 1), (18, 0, 4, 0, 3, 1, 0, 0, 0, 0, 1, 1, 1),
    (6, 1, 0, 0, 20, 0, 0, 0, 0, 0, 1, 0.3, 0), (15, 1, 30, 0, 20, 0, 0, 0, 0, 0, 1, 0.5, 0), (30, 0.9, 4, 1, 50, 0, 0, 0, 0, 0, 1, 0.6, 0), (9, 1, 3, 0, 3, 1, 0, 0, 0, 0, 1, 1, 0), (20, 0.8, 40, 0, 0, 0, 0, 0, 0, 0, 1, 0.5, 0), (12, 1, 60, 0, 0, 0, 0, 0, 0, 0, 1, 0.2, 0), (4, 0, 2, 1, 2, 1, 0, 0, 0, 0, 1, 0.1, 0), (8, 0.7, 25, 0, 25, 0, 0, 0, 0, 0, 1, 0.3, 0),
    # in an article: items, and links to read on
    (8, 0, 20, 0, 20, 0, 0, 0, 1, 1, 1, 0.4, 1), (3, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1), (20, 0.3, 30, 0, 12, 0, 0, 0, 1, 1, 1, 0.7, 1), (50, 0.1, 5, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1), (6, 0.4, 3, 0, 40, 0, 0, 0, 1, 1, 1, 0.1, 1), (2, 0, 70, 0, 70, 0, 0, 0, 1, 1, 1, 0.03, 1),
    (12, 1, 30, 0, 0, 0, 0, 0, 1, 1, 1, 0.4, 0), (5, 1, 40, 0, 10, 0, 0, 0, 1, 1, 1, 0.1, 0), (8, 0.95, 2, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0), (25, 1, 3, 0, 50, 0, 0, 0, 1, 1, 1, 0.5, 0), (30, 0.85, 20, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0), (3, 1, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0),
    # its short blocks beside long ones
    (3, 0, 60, 0, 0, 0, 0, 0, 1, 1, 0, 0.02, 1), (7, 0, 80, 0, 5, 0, 0, 0, 1, 1, 0, 0.05, 1), (12, 0, 100, 0, 0, 0, 0, 0, 1, 1, 0, 0.08, 1), (2, 0, 90, 0, 3, 0, 0, 0, 1, 1, 0, 0.02, 1), (10, 0, 5, 0, 4, 0, 0, 0, 1, 1, 0, 0.07, 1), (5, 0, 9, 0, 60, 0, 0, 0, 1, 1, 0, 0.04, 1), (9, 0, 12, 0, 14, 0, 0, 0, 1, 1, 0, 0.06, 1),
    (6, 0, 30, 0, 20, 0, 0, 0, 1, 1, 0, 0.1, 1), (14, 0, 40, 0, 8, 0, 0, 0, 1, 1, 0, 0.1, 1), (1, 0, 25, 0, 0, 0, 0, 0, 1, 1, 0, 0.01, 1), (4, 0, 0, 0, 12, 0, 0, 0, 1, 1, 0, 0.03, 1), (8, 0, 55, 0, 12, 0, 0, 0, 1, 1, 0, 0.09, 1), (4, 1, 60, 0, 9, 0, 0, 0, 1, 1, 0, 0.03, 1), (3, 0.4, 70, 0, 0, 0, 0, 0, 1, 1, 0, 0.02, 1), (7, 0, 60, 0, 30, 0, 1, 0, 1, 1, 0, 0.05, 1),
    # short blocks without an article, beside long ones
    (4, 0, 40, 0, 60, 0, 0, 0, 0, 0, 0, 0.06, 1), (9, 0, 90, 0, 20, 0, 0, 0, 0, 0, 0, 0.08, 1), (2, 0, 70, 0, 90, 0, 0, 0, 0, 0, 0, 0.02, 1), (6, 0, 14, 0, 40, 0, 0, 0, 0, 0, 0, 0.07, 1), (12, 0, 100, 0, 15, 0, 0, 0, 0, 0, 0, 0.1, 1), (5, 0, 60, 0, 0, 0, 1, 0, 0, 0, 0, 0.08, 0), (5, 0, 60, 0, 80, 0, 1, 0, 0, 0, 0, 0.06, 1), (3, 0, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0.03, 0), (4, 0.5, 90, 0, 3, 1, 0, 0, 0, 0, 0, 0.04, 0),
    # beside an article
    (20, 0, 30, 0, 0, 0, 0, 0, 0, 1, 1, 0.5, 0), (7, 1, 0, 0, 40, 0, 0, 0, 0, 1, 1, 0.2, 0),
    # pages that have nothing longer
    (4, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1), (3, 0, 0, 0, 4, 0, 0, 0, 0, 0, 0, 0.75, 1), (5, 0, 4, 0, 3, 0, 0, 0, 0, 0, 0, 1, 1), (6, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1), (4, 0, 3, 1, 5, 0, 0, 0, 0, 0, 0, 0.8, 1), (7, 0, 5, 0, 2, 1, 0, 0, 0, 0, 0, 1, 1), (2, 0, 0, 0, 5, 0, 1, 0, 0, 0, 0, 0.4, 1), (3, 0, 4, 1, 6, 0, 1, 0, 0, 0, 0, 0.5, 1), (8, 0, 2, 1, 7, 0, 0, 0, 0, 0, 0, 1, 1),
    (9, 0, 4, 0, 8, 0, 0, 0, 0, 0, 0, 1, 1), (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1), (5, 0.2, 6, 0, 0, 0, 0, 0, 0, 0, 0, 0.8, 1), (5, 1, 4, 0, 3, 0, 0, 0, 0, 0, 0, 1, 0), (2, 1, 3, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0), (6, 0.8, 0, 0, 5, 0, 0, 0, 0, 0, 0, 1, 0),
    # names that hold a word of such parts: long text stays, short or linked blocks go
    (30, 0, 20, 0, 20, 0, 0, 1, 1, 1, 0, 0.5, 1), (12, 0, 40, 0, 0, 0, 0, 1, 1, 1, 0, 0.3, 1), (25, 0.1, 0, 0, 30, 0, 0, 1, 1, 1, 0, 0.8, 1), (9, 0, 30, 0, 30, 0, 0, 1, 1, 1, 0, 0.3, 1), (60, 0.2, 12, 0, 0, 0, 0, 1, 1, 1, 0, 1, 1), (8, 0, 9, 0, 10, 0, 0, 1, 1, 1, 0, 0.8, 1), (3, 0, 0, 0, 40, 0, 1, 1, 1, 1, 0, 0.1, 1), (1, 0, 17, 0, 17, 0, 1, 1, 1, 1, 0, 0.06, 1), (2, 0, 30, 0, 60, 0, 1, 1, 1, 1, 0, 0.03, 1), (4, 0, 12, 0, 25, 0, 1, 1, 1, 1, 0, 0.15, 1), (6, 0, 50, 0, 14, 0, 1, 1, 1, 1, 0, 0.1, 1), (2, 0, 15, 0, 8, 0, 1, 1, 0, 0, 0, 0.1, 1), (3, 0, 30, 0, 40, 0, 1, 1, 0, 0, 0, 0.1, 1), (5, 0, 20, 0, 0, 0, 1, 1, 1, 1, 0, 0.3, 1), (30, 0, 4, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1),
    (3, 0, 40, 0, 40, 0, 0, 1, 1, 1, 0, 0.1, 0), (4, 0.5, 30, 0, 0, 0, 0, 1, 1, 1, 0, 0.1, 0), (6, 1, 25, 0, 12, 0, 0, 1, 1, 1, 0, 0.2, 0), (20, 0.8, 40, 0, 0, 0, 0, 1, 1, 1, 0, 0.5, 0), (2, 0, 12, 0, 30, 0, 0, 1, 1, 1, 0, 0.1, 0), (14, 0.9, 50, 0, 0, 0, 0, 1, 1, 1, 1, 0.3, 0), (5, 0, 60, 0, 0, 0, 0, 1, 1, 1, 0, 0.1, 0),
    (40, 0, 30, 0, 30, 0, 0, 1, 0, 0, 0, 1, 1), (25, 0, 0, 0, 60, 0, 0, 1, 0, 0, 0, 0.4, 1), (16, 0.1, 30, 0, 14, 0, 0, 1, 0, 0, 0, 0.5, 1), (6, 0, 30, 0, 20, 0, 0, 1, 0, 0, 0, 0.2, 0), (30, 0.7, 40, 0, 0, 0, 0, 1, 0, 0, 0, 0.7, 0), (3, 0, 50, 0, 50, 0, 0, 1, 0, 0, 0, 0.1, 0), (40, 0, 30, 0, 0, 0, 0, 1, 0, 1, 0, 1, 0), (15, 0, 0, 0, 50, 0, 0, 1, 0, 1, 0, 0.3, 0),
    # in parts that an element names as none
    (40, 0, 50, 0, 30, 0, 0, 3, 0, 0, 0, 0.8, 0), (70, 0, 60, 0, 0, 0, 0, 3, 1, 1, 0, 1, 0), (5, 0, 40, 0, 40, 0, 1, 3, 0, 0, 0, 0.1, 0), (3, 0, 20, 0, 20, 0, 1, 3, 1, 1, 0, 0.1, 0), (30, 0, 30, 0, 0, 0, 0, 3, 0, 1, 0, 1, 0), (12, 0, 30, 0, 30, 0, 0, 3, 1, 1, 1, 0.4, 0), (6, 0, 0, 0, 0, 0, 0, 3, 0, 0, 0, 1, 0), (20, 0, 20, 0, 20, 0, 0, 2, 1, 1, 1, 0.6, 0), (4, 0, 3, 0, 0, 0, 0, 2, 0, 0, 0, 1, 0),
]


def labelled_table() -> np.ndarray:
    """All labelled blocks with all features. Of those without the last one the longest block is taken to be the longest that the row tells of; short ones that aren't text stand on pages with one of 60 words."""
    old = np.array(LABELLED, float)
    x, y = old[:, :-1], old[:, -1:]
    x[:, 7] *= STRONG
    longest = np.maximum.reduce([x[:, 0], x[:, 2], x[:, 4], np.where((y[:, 0] == 0) & (x[:, 9] == 0), 60.0, 1.0)])
    return np.concatenate([np.column_stack([x, np.zeros(len(x)), x[:, 0] / longest, y]), np.array(LABELLED_TOO, float)])


#: The rest of a tag, after its name: attributes may hold `>` in quotes.
_REST = re.compile(r"""((?:"[^"]*"|'[^']*'|[^"'>])*+)>""")
_NAME = re.compile(r"[a-zA-Z][^\s>/]*")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Za-z]+")


def _named(attributes: str, element: str) -> tuple[int, bool]:
    """How surely the attributes name a part that is no article, and whether they name the main part."""
    if not attributes:
        return 0, False
    apart, main = SURE if _HIDDEN.search(attributes) else 0, False
    if element in HEADING:
        return apart, main  # a heading's names tell what it heads
    for found in _NAMES.finditer(attributes):
        anchor = found[0][:2].lower() == "id" and element == "section"  # what a link within the page leads to
        for name in "".join(x or "" for x in found.groups()).split():
            parts = [x.lower() for x in _PART.findall(name)]
            main |= parts == ["main"]
            if APART_WORDS.isdisjoint(parts) or parts[0] in ("has", "no", "with") or element in ("p", "li") and len(parts) > 1:
                continue  # names like related-work: of a paragraph only the plain words count
            if not OWN_WORDS.isdisjoint(parts) and parts[-1] in ("header", "related", "work", "works", "text", "title", "content", "body"):
                continue
            last = next((x for x in reversed(parts) if x not in PLAIN_WORDS), "")
            apart = max(apart, STRONG if last in APART_WORDS and not anchor else WEAK)
    return apart, main


def _tags(page: str):
    """(text before, closing, name, attributes) of each tag, then the last text with no name; comments and declarations part nothing.

    One pass: what a search has looked at is not looked at again. A tag that never ends takes the rest of the page with it, and after a
    quote that is never closed quotes have no meaning.
    """
    at, end, last, quotes, unclosed = 0, len(page), page.rfind(">"), True, set()
    start = at
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= end:
            break
        second = page[lt + 1]
        if second in "!?":
            comment = page.startswith("<!--", lt)
            close = page.find("-->", lt + 4) if comment else page.find(">", lt)
            yield page[start:lt], False, "!", ""
            start = at = end if close < 0 else close + (3 if comment else 1)
            continue
        name = _NAME.match(page, lt + 1 + (second == "/"))
        if not name:
            at = lt + 1
            continue
        if lt > last:
            yield page[start:lt], False, "!", ""
            start = end
            break
        rest = _REST.match(page, name.end()) if quotes else None
        if rest:
            attributes, at = rest[1], rest.end()
        else:
            quotes = False
            at = page.find(">", name.end()) + 1
            attributes = page[name.end() : at - 1]
        element = name[0].lower()
        yield page[start:lt], second == "/", element, attributes
        if element in RAW and second != "/" and not attributes.rstrip().endswith("/") and element not in unclosed:
            close = re.compile(f"</{element}\\b[^>]*>", re.I).search(page, at)
            if close:
                at = close.end()
            else:
                unclosed.add(element)
                at = end if element in ("script", "style", "template") else at
        start = at
    yield page[start:], False, "", ""


def blocks(page: str) -> list[tuple[str, int, int, int, bool, bool, int]]:
    """(text, words, words in links, apart, in article, heading, list) of each flat block with a word, in page order; list: the number of the outermost list around it, 0 if none."""
    out, words, linked, depth_a, pending = [], [], 0, 0, []
    stack: list[tuple[str, int, bool, int]] = []  # open elements but p and plain inline ones: name, apart, in article, list
    open_: Counter = Counter()
    apart, main, heading, listed, lists = 0, False, False, 0, 0

    def add_text():
        nonlocal linked
        if pending:
            found = html.unescape("".join(pending)).split()
            words.extend(found)
            linked += len(found) if depth_a else 0
            pending.clear()

    def end_block():
        nonlocal words, linked
        add_text()
        if words:
            out.append((" ".join(words), len(words), linked, (0 if heading else SURE) if apart == BUT_HEADINGS else apart, main, heading, listed))
        words, linked = [], 0

    def push(name: str, a: int, m: bool, number: int):
        stack.append((name, a, m, number))
        open_[name] += 1

    def pop():
        open_[stack.pop()[0]] -= 1

    def where() -> tuple[int, bool, int]:
        return stack[-1][1:] if stack else (0, False, 0)

    def both(a: int, b: int) -> int:
        return SURE if SURE in (a, b) else max(a, b)

    # A word can run across inline tags, so text gathers until a tag parts words or changes what it belongs to.
    for text, closing, name, attributes in _tags(page):
        pending.append(text)
        if name in ("", "!"):
            continue
        if name in ("br", "td", "th") or name in RAW:
            pending.append(" ")
        elif name == "a":
            add_text()
            depth_a = 0 if closing else 1
        elif name in VOID and name != "hr":
            pass
        elif name in INLINE:
            if not closing and attributes and (named := _named(attributes, name)[0]):
                end_block()
                apart = both(apart, named)
                push(name, apart, main, listed)
            elif closing and stack and stack[-1][0] == name:
                end_block()
                pop()
                apart, main, listed = where()
        else:
            end_block()
            depth_a = 0
            plain = name in ("hr", "html", "body", "head")
            if closing:
                if not plain and open_[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
            elif not plain:
                if name in ("p", "li") and stack and stack[-1][0] == name:
                    pop()
                    apart, main, listed = where()
                named_apart, named_main = _named(attributes, name)
                if name not in ("p", "li") or named_apart:
                    own = BUT_HEADINGS if name == "header" and main and not named_apart else SURE if name in APART else 0 if name in MAIN and named_apart < SURE else named_apart
                    lists += (new := name in LISTS and not listed)
                    push(name, both(apart, own), main or name in MAIN or named_main, lists if new else listed)
            apart, main, listed = where()
            heading = name in HEADING and not closing
    end_block()
    return out


def units(page: list[tuple]) -> tuple[list[tuple], list[int]]:
    """(words, words in links, apart, in article, heading, list) of each block of a page, the items of a list together; and the number of each block's unit."""
    out, of = [], []
    last = None
    for _, words, linked, apart, main, heading, listed in page:
        key = (listed, apart, main) if listed else None
        if key and key == last:
            out[-1] = (out[-1][0] + words, out[-1][1] + linked, *out[-1][2:])
        else:
            out.append((words, linked, apart, main, heading and not listed, listed > 0))
        of.append(len(out) - 1)
        last = key
    return out, of


def features(pages: list[list]) -> np.ndarray:
    """A row of FEATURES for each unit of each page; beyond a page's first and last unit are zeros."""
    found = [b for page in pages for b in page]
    n, of = len(found), np.repeat(np.arange(len(pages)), [len(page) for page in pages])
    words, linked, apart, main, heading, listed = np.array(found, float).reshape(n, 6).T
    own = apart < STRONG  # units apart are no neighbours
    # Neighbours of all pages in a row, three zeros between pages: for each unit the place of its own, or of the next.
    place = 3 * (of + 1) + np.cumsum(own) - own
    size = np.zeros((2, 3 * (len(pages) + 1) + int(own.sum())))
    size[0, place[own]], size[1, place[own]] = words[own], linked[own]

    def around(steps: list[np.ndarray]) -> list[np.ndarray]:
        near, links = (np.stack([size[c][k] for k in steps]) for c in (0, 1))
        return [near.max(0), links.sum(0) / np.maximum(near.sum(0), 1)]

    before, after = around([place - k for k in (1, 2, 3)]), around([place + own + k for k in (0, 1, 2)])
    # A page names its article if a unit that may be text lies in it.
    named = np.bincount(of, main * own, len(pages))[of] > 0
    longest = np.ones(len(pages))
    np.maximum.at(longest, of, np.where(own, words - linked, 0))
    return np.column_stack([words, linked / words, *before, *after, heading, apart, main, named, listed, np.minimum(words / longest[of], 1)])


def grow_tree(x: np.ndarray, y: np.ndarray) -> tuple:
    """A decision tree: (share of 1,) for a leaf, or (feature, threshold, below or equal, above). Splits by Gini impurity."""
    if y.min() == y.max() or len(y) < 2:
        return (float(y.mean()),)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            gini = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (left, ~left))
            best = min(best, (round(float(gini), 9), f, float(t)))
    if best[0] == np.inf:
        return (float(y.mean()),)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow_tree(x[left], y[left]), grow_tree(x[~left], y[~left]))


def apply_tree(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = apply_tree(tree[2], x[left]), apply_tree(tree[3], x[~left])
    return out


@lru_cache(1)
def fitted_tree() -> tuple:
    table = labelled_table()
    return grow_tree(table[:, :-1], table[:, -1])


def main_texts(pages: list[str | None]) -> list[str]:
    found = [blocks(page or "") for page in pages]
    if not any(found):
        return [""] * len(pages)
    parted = [units(page) for page in found]
    kept = apply_tree(fitted_tree(), features([made for made, _ in parted])) > 0.5
    ends = np.cumsum([0, *(len(made) for made, _ in parted)])
    return ["\n".join(b[0] for b, k in zip(page, of, strict=True) if kept[start + k]) for page, (_, of), start in zip(found, parted, ends[:-1], strict=True)]


def main_text(page: str | None) -> str:
    return main_texts([page])[0]


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, text, n_chars (code points).

    Character references are decoded, white space in a block becomes one space, blocks are joined by a newline in page
    order. Null or empty html, and pages without main text, give an empty text. Pages are handled one by one and whole,
    however long; repeated rows give repeated rows; other columns of pages aren't returned. An empty table gives no rows.
    """

    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def text_of(pages: pa.Array) -> pa.Array:
        out = []
        for _, part in in_slices(pages):
            out += main_texts(part.to_pylist())
        return pa.array(out, pa.string())

    return pages.select(id_col, url_col, text_of(html_col).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
