"""Other names of genres, a table that a caller of ``map_values`` gives."""

# Other names of genres, in several languages.
OTHER_NAMES = {
    "Action": "actioner|acción|accion|aktion|aktionsfilm|azione|ação|боевик|экшн|actionfilm|action-packed|shoot em up",
    "Adventure": "adv|aventure|aventures|aventura|aventuras|abenteuer|abenteuerfilm|avventura|приключения|приключенческий|adventurous|quest",
    "Animation": "anim|anime|animated|cartoon|cartoons|zeichentrick|zeichentrickfilm|dessin animé|dessins animés|animación|animazione|animação|мультфильм|мультфильмы|анимация|аниме|trickfilm",
    "Biography": "bio|biopic|biographical|biografie|biographie|biografía|biografia|биография|биографический|life story|true story",
    "Comedy": "com|comedia|comédie|comedie|komödie|komoedie|commedia|comédia|комедия|funny|humor|humour|sitcom|laughs",
    "Crime": "crimen|krimi|kriminalfilm|policier|polar|policíaco|policiaco|crimine|криминал|криминальный|gangster|mafia|heist|true crime",
    "Documentary": "doc|docs|docu|doku|dokumentarfilm|dokumentation|documentaire|documental|documentario|documentário|документальный|документальное|documentaries|docuseries",
    "Drama": "drame|dramatic|dramático|dramma|драма|dramas|melodrama|schauspiel",
    "Family": "fam|familie|famille|familia|familiar|famiglia|família|familienfilm|семейный|семейное|all ages",
    "Fantasy": "fantastique|fantasía|fantasia|fantástico|фэнтези|фентези|magical|sword and sorcery",
    "History": "historie|histoire|historia|historique|histórico|geschichte|storia|storico|исторический|история|historical|period piece|period drama|costume drama",
    "Horror": "horreur|horrorfilm|terror|orrore|ужасы|ужас|хоррор|scary|épouvante|grusel|gruselfilm|fright",
    "Music": "musique|musik|música|musica|музыка|музыкальный|concert|concerts|konzert|concierto",
    "Musical": "comédie musicale|comedie musicale|musicals|musicales|мюзикл|broadway|broadway style|singspiel",
    "Mystery": "mystère|mystere|misterio|mistero|mistério|mysterium|детектив|тайна|whodunit|detective|sleuth",
    "Romance": "rom|romantic|romantique|romántico|romantik|romantico|liebesfilm|liebe|мелодрама|романтика|романтический|love story|love|amour",
    "Thriller": "suspense|suspenso|suspenseful|триллер|thrillers|spannung",
    "Western": "westerns|cowboy|cowboys|вестерн|wild west|oater|wildwest",
    "War": "wartime|wars|guerre|guerra|krieg|kriegsfilm|bélico|belico|военный|война|battlefield|military",
    "Sport": "sports|athletics|deporte|deportes|sportif|sportfilm|esporte|спорт|спортивный|athletic",
    "Noir": "film noir|neo noir|neo-noir|cine negro|нуар|noirs|schwarze serie",
    "Anthology": "anthologie|antología|antologia|antologie|антология|omnibus|альманах",
    "Satire": "satira|sátira|satirical|satirique|satirisch|сатира|spoof|parody",
    "Disaster": "catastrophe|catástrofe|catastrofe|desastre|katastrophe|katastrophenfilm|катастрофа|фильм катастрофа|catastrophic",
    "Espionage": "spy|spies|spionage|spionagefilm|espionnage|espionaje|spionaggio|шпионский|шпионаж|secret agent|secret agents|spy film",
    "Superhero": "superheroes|super heroes|super hero|super-heroes|superhéroes|superheroe|superhelden|super-héros|supereroi|супергерои|супергерой|супергеройский|capes|comic book",
    "Martial Arts": "kung fu|kungfu|karate|kampfkunst|arts martiaux|artes marciales|arti marziali|боевые искусства|единоборства|wuxia|judo",
    "Reality": "reality tv|reality television|tv reality|reality show|unscripted|télé réalité|telerrealidad|реалити|реалити шоу|realityshow|realityserie",
    "Soap": "soap opera|soaps|telenovela|telenovelas|seifenoper|feuilleton|мыльная опера|soapie|daily soap",
    "News": "nachrichten|noticias|nouvelles|actualités|notizie|notícias|новости|current affairs|newscast|headlines",
    "Kids": "children|childrens|children's|kinder|kinderfilm|enfants|niños|infantil|bambini|детский|детское|дети|for kids",
    "Politics": "political|politik|politique|política|politica|политика|политический|politisch|politico|elections",
    "Science Fiction": "sf|scifi|sci fi|sci-fi|ciencia ficción|ciencia ficcion|fantascienza|ficção científica|фантастика|научная фантастика|syfy|sciencefiction|space opera|science-fiction",
    "Game Show": "gameshow|quiz|quiz show|quizshow|spielshow|jeu télévisé|concurso|викторина|телевикторина|game shows|panel game",
    "Talk Show": "talkshow|talk|late night|latenight|chat show|débat|ток шоу|ток-шоу|tertulia|interview show",
    "Courtroom": "legal|trial|court|court drama|lawyers|gericht|gerichtsfilm|gerichtsdrama|tribunal|prétoire|судебный|суд|judicial|procès|juicio",
    "Medical": "doctors|doctor|hospital|hospitals|arztserie|arzt|médical|médico|medico|medizin|krankenhaus|медицинский|медицина|больница|врачи",
    "Travel": "travelogue|travelogues|voyage|voyages|reise|reisen|viaje|viajes|viaggio|viaggi|путешествия|путешествие|tourism|road trip",
    "Cooking": "food|cooking show|culinary|cuisine|kochen|kochshow|cocina|cucina|gastronomie|кулинария|кулинарный|готовка|baking|chefs",
    "Nature": "wildlife|natur|naturaleza|natura|природа|naturfilm|animals|nature documentary|outdoors|animaux",
    "Supernatural": "paranormal|ghosts|ghost|übernatürlich|uebernatuerlich|surnaturel|sobrenatural|sovrannaturale|soprannaturale|сверхъестественное|мистика|haunted|occult",
    "Slasher": "слэшер|слешер|slashers|slasherfilm|splatter|carnage",
}
