"""The word lists that questions, entities and reranking are judged by. Results depend on every entry."""

# Greetings and fillers that are no questions.
NOISE = """
hello hi hey thanks|thank you|ok okay bye goodbye yes no sure cool nice good great fine help please yo sup
hola greetings howdy cheers thx ty np nope yep yeah yea nah
"""

# Words that are no topic of a conversation.
NO_TOPIC = """
the a an this that these those it they them i you we is are was were be been
yes no ok okay sure thanks well so just really
"""

# Words of a question that are no keywords in heuristic reranking.
NO_KEYWORD = """
what when where who how which did do was were have has had is are the a an my me i you your their it its
in on at to for of with by from ago last that this there about get got give gave buy bought made make said
and but not all can her his one our out new now old see way too use yes also been call come each just like much
must only over such take than them then they very well will some would could should shall may might does going
think know want need tell told asked something anything everything nothing someone anyone everyone
"""

# Capitalised words that are no names in heuristic reranking.
NO_NAME = """
What When Where Who How Which Did Do Was Were Have Has Had Is Are The My Our Their Can Could Would Should Will
Shall May Might Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August
September October November December In On At For To Of With By From And But It Its This That These Those Also Just
Very More Said Speaker Person Time Date Year Day Previously Recently
"""

# Words that are no entities in retrieval over several hops.
NO_ENTITY = """
the and for are but not you all can had her was one our out has his how its may new now old see way who did
get let say she too use yes yet hey said also been call come each from have here just like made make much must name
only over such take than that them then they this very when what with will well your about after could every first found
great house large later never other place right shall small some still their there these thing think those three under where
which while world would yeah okay sure really actually session user speaker unknown date time today yesterday tomorrow
monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december
shared image told asked went going know want need something anything everything nothing someone anyone everyone
"""


def entries(text: str) -> list[str]:
    """The words of a list; an entry of two words stands between bars."""
    out: list[str] = []
    for line in text.split("\n"):
        cut = line.split("|")
        for i, part in enumerate(cut):
            out += [part] if 0 < i < len(cut) - 1 else part.split()
    return out
