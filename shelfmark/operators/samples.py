"""Sample texts for the default language profiles.

Fixed values: articles 1 to 3 and 19 of the Universal Declaration of Human Rights, a public text.
"""

LANGUAGE_SAMPLES = {
    "en": (
        "All human beings are born free and equal in dignity and rights. They are endowed with "
        "reason and conscience and should act towards one another in a spirit of brotherhood. "
        "Everyone is entitled to all the rights and freedoms set forth in this Declaration, "
        "without distinction of any kind, such as race, colour, sex, language, religion, "
        "political or other opinion, national or social origin, property, birth or other status. "
        "Everyone has the right to life, liberty and security of person. Everyone has the right "
        "to freedom of opinion and expression; this right includes freedom to hold opinions "
        "without interference and to seek, receive and impart information and ideas through any "
        "media and regardless of frontiers."
    ),
    "de": (
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft "
        "und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat "
        "Anspruch auf die in dieser Erklärung verkündeten Rechte und Freiheiten ohne irgendeinen "
        "Unterschied, etwa nach Rasse, Hautfarbe, Geschlecht, Sprache, Religion, politischer oder "
        "sonstiger Überzeugung, nationaler oder sozialer Herkunft, Vermögen, Geburt oder "
        "sonstigem Stand. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. "
        "Jeder hat das Recht auf Meinungsfreiheit und freie Meinungsäußerung; dieses Recht "
        "schließt die Freiheit ein, Meinungen ungehindert anzuhängen sowie über Medien jeder Art "
        "und ohne Rücksicht auf Grenzen Informationen und Gedankengut zu suchen, zu empfangen und "
        "zu verbreiten."
    ),
    "fr": (
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués "
        "de raison et de conscience et doivent agir les uns envers les autres dans un esprit de "
        "fraternité. Chacun peut se prévaloir de tous les droits et de toutes les libertés "
        "proclamés dans la présente Déclaration, sans distinction aucune, notamment de race, de "
        "couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion, "
        "d'origine nationale ou sociale, de fortune, de naissance ou de toute autre situation. "
        "Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Tout "
        "individu a droit à la liberté d'opinion et d'expression, ce qui implique le droit de ne "
        "pas être inquiété pour ses opinions et celui de chercher, de recevoir et de répandre, "
        "sans considérations de frontières, les informations et les idées par quelque moyen "
        "d'expression que ce soit."
    ),
    "es": (
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como "
        "están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. "
        "Toda persona tiene todos los derechos y libertades proclamados en esta Declaración, sin "
        "distinción alguna de raza, color, sexo, idioma, religión, opinión política o de "
        "cualquier otra índole, origen nacional o social, posición económica, nacimiento o "
        "cualquier otra condición. Todo individuo tiene derecho a la vida, a la libertad y a la "
        "seguridad de su persona. Todo individuo tiene derecho a la libertad de opinión y de "
        "expresión; este derecho incluye el de no ser molestado a causa de sus opiniones, el de "
        "investigar y recibir informaciones y opiniones, y el de difundirlas, sin limitación de "
        "fronteras, por cualquier medio de expresión."
    ),
    "it": (
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati "
        "di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di "
        "fratellanza. Ad ogni individuo spettano tutti i diritti e tutte le libertà enunciate "
        "nella presente Dichiarazione, senza distinzione alcuna, per ragioni di razza, di colore, "
        "di sesso, di lingua, di religione, di opinione politica o di altro genere, di origine "
        "nazionale o sociale, di ricchezza, di nascita o di altra condizione. Ogni individuo ha "
        "diritto alla vita, alla libertà ed alla sicurezza della propria persona. Ogni individuo "
        "ha diritto alla libertà di opinione e di espressione, incluso il diritto di non essere "
        "molestato per la propria opinione e quello di cercare, ricevere e diffondere "
        "informazioni e idee attraverso ogni mezzo e senza riguardo a frontiere."
    ),
    "pt": (
        "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de "
        "razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. "
        "Todos os seres humanos podem invocar os direitos e as liberdades proclamados na presente "
        "Declaração, sem distinção alguma, nomeadamente de raça, de cor, de sexo, de língua, de "
        "religião, de opinião política ou outra, de origem nacional ou social, de fortuna, de "
        "nascimento ou de qualquer outra situação. Todo o indivíduo tem direito à vida, à "
        "liberdade e à segurança pessoal. Todo o indivíduo tem direito à liberdade de opinião e "
        "de expressão, o que implica o direito de não ser inquietado pelas suas opiniões e o de "
        "procurar, receber e difundir, sem consideração de fronteiras, informações e ideias por "
        "qualquer meio de expressão."
    ),
}
