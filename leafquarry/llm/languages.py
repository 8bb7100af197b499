"""Function words of the four languages, for guessing a text's language from the text alone."""

# Fixed values.
STOPWORDS = {
    "en": "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two him see could no make than been its now my made did get who may he you a i".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich du wir ihr".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou comme mais on y nous si leur cette ont été sans fait même aux elle ces tout bien être peut deux lui après je tu vous avoir".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos".split(),
}
LANGUAGES = tuple(STOPWORDS)
EVERY_STOPWORD = frozenset(w for words in STOPWORDS.values() for w in words)
