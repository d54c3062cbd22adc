"""The literary measures' German and French lists, as the reference has them: words are single tokens in lower case."""

# Fixed values; articles and demonstratives stand in for the determiners that a tagger would find.
LANGUAGES: dict[str, dict] = {
    "DE": {
        "function_words": """
            die der und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer
            um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde ihr hatte kann gegen vom können
            schon wenn habe seine mark ihre dann unter wir mir ihn diese diesem dieses worden""".split(),
        "logos": """
            deshalb daher folglich infolgedessen demnach somit mithin ergo beweis beweise daten statistik studie studien forschung untersuchung
            analyse ergebnisse befunde nachweis belege bericht zahlen prozent zeigt belegt beweist bestätigt zeigen belegen beweisen bestätigen ergibt
            ergeben folgt impliziert""".split(),
        "ethos": """
            experte experten wissenschaftler forscher gelehrter professor autorität fachmann fachleute studie literatur konsens belegt bestätigt
            anerkannt verlässlich glaubwürdig""".split(),
        "pathos": """
            liebe angst hoffnung freude schmerz trauer stolz scham wut verzweiflung glück leid mitgefühl empathie würde gerechtigkeit freiheit
            unterdrückung unschuld opfer familie kinder gemeinschaft menschlichkeit mut tragödie tief zutiefst erschütternd bewegend herzzerreißend
            entsetzlich wunderschön tragisch dringend überwältigend erschreckend leidenschaftlich""".split(),
        "interrogatives": """
            wer wem wen wessen was warum weshalb weswegen wieso wie wann wo wohin woher wobei womit welcher welche welches inwieweit""".split(),
        "rhetorical": """
            jeder jede jedes jemand niemand alle alles keiner keine keines wir man irgendwer irgendwas""".split(),
        "contrastive": """
            aber jedoch doch sondern obwohl während wohingegen""".split(),
        "coordinating": """
            und oder noch aber denn""".split(),
        "determiners": """
            der die das den dem des ein eine einer einem einen eines dieser diese dieses diesem diesen""".split(),
        "phrases": {
            "logos": ["zum beispiel", "beispielsweise", "zum einen", "laut studien", "forschungen zeigen", "daten zeigen", "wie gezeigt wurde", "wie belegt wird", "als beweis dafür", "dies beweist", "dies zeigt", "daraus folgt", "als ergebnis", "infolge dessen", "auf der grundlage", "auf basis von"],
            "ethos": ["laut", "gemäß", "nach angaben von", "nach aussage von", "experten sind sich einig", "wissenschaftler zeigen", "es ist allgemein anerkannt", "wie allgemein bekannt", "in der wissenschaft", "laut forschung", "nach aktuellen studien", "aus meiner erfahrung", "als fachmann"],
            "pathos": ["denken wir an die kinder", "unsere kinder", "unsere familien", "um des willens", "wir können nicht wegschauen", "das menschliche leid", "leben stehen auf dem spiel", "niemand sollte", "jeder verdient"],
        },
        "vowels": "aeiouäöüy",
    },
    "FR": {
        "function_words": """
            le de la les des et en du un une à il est que se qui ce dans pas sur ne par au avec plus son ou sa lui mais tout elle y si leur on me nous
            vous ils elles mon ma mes ton ta tes ses aux cet cette ces dont j l d n s ont été aussi car comme même très bien alors encore peut être
            faire avoir dit fait sans ni entre sous vers""".split(),
        "logos": """
            donc ainsi preuve preuves données statistiques étude études recherche analyse résultats conclusions rapport chiffres pourcentage enquête
            montre montrent prouve prouvent confirme confirment démontre démontrent indique indiquent révèle révèlent""".split(),
        "ethos": """
            expert experts scientifique scientifiques chercheur chercheurs professeur autorité spécialiste littérature consensus établi vérifié
            confirmé fiable crédible""".split(),
        "pathos": """
            amour peur espoir joie douleur chagrin deuil fierté honte colère désespoir bonheur tristesse compassion empathie souffrance sacrifice
            dignité justice liberté oppression innocent victime enfants famille communauté humanité courage profondément terriblement désespérément
            passionnément bouleversant déchirant magnifique tragique urgent alarmant émouvant touchant""".split(),
        "interrogatives": """
            qui que quoi pourquoi comment quand où lequel laquelle lesquels lesquelles quel quelle quels quelles combien""".split(),
        "rhetorical": """
            tout tous toute toutes chacun chacune personne nous on nul nulle aucun aucune quiconque""".split(),
        "contrastive": """
            mais cependant pourtant néanmoins toutefois tandis whereas""".split(),
        "coordinating": """
            et ou ni mais car""".split(),
        "determiners": """
            le la les l un une des du ce cet cette ces""".split(),
        "phrases": {
            "logos": ["par exemple", "notamment", "à titre d'exemple", "les données montrent", "les études montrent", "selon les recherches", "il en ressort que", "on peut conclure", "cela démontre", "cela prouve", "en conclusion", "en résumé", "sur la base de", "à la lumière de", "compte tenu de"],
            "ethos": ["selon", "d'après", "comme l'indique", "les experts s'accordent", "les scientifiques montrent", "il est largement admis", "il est bien établi", "d'après les recherches", "selon les études", "de mon expérience", "en tant que professionnel"],
            "pathos": ["pensons aux enfants", "nos enfants", "nos familles", "pour le bien de", "nous ne pouvons pas rester indifférents", "le coût humain", "des vies sont en jeu", "personne ne devrait", "tout le monde mérite", "au cœur de", "profondément bouleversant"],
        },
        "vowels": "aeiouàâéèêëîïôùûüœæy",
    },
}
