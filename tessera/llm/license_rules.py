"""The signature rules of the license scan, over lower-cased words joined by single blanks.

Each is (priority, label, keyword, pattern, confidence): a rule runs where its keyword stands, and its
pattern matches nothing without it. Written one by one, but for the two families at the end.
"""

from __future__ import annotations

Rule = tuple[int, str, str, str, float]

#: Sentences and addresses of license texts (3), statements about use (2), weak signs (1).
STATEMENTS: list[Rule] = [
    (3, "mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.99),
    (3, "isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.99),
    (3, "bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 0.97),
    (3, "bsd-3-clause", "neither the name of", "neither the name of (?:the )?(?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse", 0.95),
    (3, "apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 0.99),
    (3, "apache-2.0", "apache org licenses", "(?:https?|http) www apache org licenses license 2 0", 0.95),
    (3, "gpl-2.0-or-later", "either version 2", "either version 2 of the license or at your option any later version", 0.97),
    (3, "gpl-3.0-or-later", "either version 3", "either version 3 of the license or at your option any later version", 0.97),
    (3, "lgpl-2.1-or-later", "either version 2 1", "either version 2 1 of the license or at your option any later version", 0.97),
    (3, "gpl", "redistribute it and or modify", "(?:this program is )?free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.98),
    (3, "gpl", "gnu org licenses", "www gnu org licenses gpl", 0.9),
    (3, "mpl-2.0", "source code form is subject to", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.99),
    (3, "unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain", 0.99),
    (3, "bsl-1.0", "boost org license", "boost org license 1 0", 0.9),
    (3, "zlib", "provided as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.95),
    (3, "cc0-1.0", "creativecommons org", "creativecommons org publicdomain zero 1 0", 0.97),
    (3, "cc-by", "creativecommons org", "creativecommons org licenses by(?: [1-4] [05])", 0.95),
    (3, "cc-by-sa", "creativecommons org", "creativecommons org licenses by sa(?: [1-4] [05])?", 0.97),
    (3, "cc-by-nc", "creativecommons org", "creativecommons org licenses by nc(?: [1-4] [05])?", 0.97),
    (3, "cc-by-nd", "creativecommons org", "creativecommons org licenses by nd(?: [1-4] [05])?", 0.97),
    (3, "cc-by-nc-sa", "creativecommons org", "creativecommons org licenses by nc sa(?: [1-4] [05])?", 0.97),
    (3, "cc-by-nc-nd", "creativecommons org", "creativecommons org licenses by nc nd(?: [1-4] [05])?", 0.97),
    (2, "gpl", "general public license", "gnu general public license", 0.9),
    (2, "lgpl", "general public license", "(?:gnu )?(?:lesser|library) general public license", 0.92),
    (2, "agpl", "general public license", "(?:gnu )?affero general public license", 0.92),
    (2, "gpl", "gpl", "gnu gpl", 0.85),
    (2, "lgpl", "lgpl", "(?:gnu )?lgpl", 0.85),
    (2, "agpl", "agpl", "(?:gnu )?agpl", 0.85),
    (2, "apache", "apache", "apache (?:software )?license", 0.8),
    (2, "mozilla", "mozilla", "mozilla public license", 0.8),
    (2, "eclipse", "eclipse", "eclipse public license", 0.8),
    (2, "creative-commons", "creative commons", "creative commons (?:attribution )?licen[cs]e", 0.8),
    (2, "cc-by", "creative commons", "creative commons attribution", 0.8),
    (2, "public-domain", "public domain", "(?:placed|released|dedicated|put)(?: in| into| to)? the public domain", 0.9),
    (2, "proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary)", 0.9),
    (2, "proprietary", "unauthorized", "unauthorized (?:copying|reproduction|use|distribution)(?: of this [^ ]+)?(?: or [^ ]+)?(?: [^ ]+)? is (?:strictly )?prohibited", 0.85),
    (2, "non-commercial", "commercial use only", "(?:for )?non ?commercial use only", 0.8),
    (2, "non-commercial", "personal use only", "(?:for )?personal use only", 0.8),
    (2, "no-derivatives", "derivative", "no derivative works", 0.7),
    (2, "no-redistribution", "redistribut", "(?:may not be|not be|no) redistribut(?:ed|ion)(?: without (?:prior |written )*(?:permission|consent))?", 0.8),
    (2, "permission-required", "permission", "(?:used|reproduced|reprinted) (?:only )?(?:with|by) (?:the )?(?:express |prior |written )*permission", 0.7),
    (1, "public-domain", "public domain", "public domain", 0.5),
    (1, "bsd", "bsd", "bsd(?: style)? license", 0.7),
    (1, "gpl", "gpl", "gpl", 0.6),
    (1, "copyright", "copyright", "copyright (?:c |© ?)?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 0.5),
    (1, "copyright", "copyrighted", "copyrighted (?:material|work|content)", 0.4),
    (3, "mit", "the software is provided as is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.9),
    (3, "mit", "shall be included in all copies", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.97),
    (3, "bsd", "this software is provided by the", "this software is provided by the (?:[^ ]+ ){1,8}as is and any express or implied warranties", 0.93),
    (3, "bsd", "redistributions of source code must", "redistributions of source code must retain the above copyright notice this list of conditions", 0.97),
    (3, "bsd", "redistributions in binary form must", "redistributions in binary form must reproduce the above copyright notice this list of conditions", 0.97),
    (3, "bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 0.95),
    (3, "apache-2.0", "limitations under the license", "see the license for the specific language governing permissions and limitations under the license", 0.9),
    (3, "apache-2.0", "you may obtain a copy of the license at", "you may obtain a copy of the license at https? www apache org", 0.95),
    (3, "apache-2.0", "terms and conditions for use reproduction", "apache license version 2 0 january 2004(?: https? www apache org licenses)? terms and conditions for use reproduction and distribution", 0.99),
    (3, "gpl", "everyone is permitted to copy", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.95),
    (3, "gpl", "without any warranty", "this program is distributed in the hope that it will be useful but without any warranty", 0.93),
    (3, "gpl", "you should have received a copy", "you should have received a copy of the gnu general public license along with this (?:program|file|software|library)", 0.97),
    (3, "lgpl", "you should have received a copy", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|file|software|library)", 0.97),
    (3, "agpl", "you should have received a copy", "you should have received a copy of the gnu affero general public license along with this (?:program|file|software|library)", 0.97),
    (3, "gfdl", "permission is granted to copy", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.99),
    (3, "gfdl", "with no invariant sections", "with no invariant sections no front cover texts and no back cover texts", 0.97),
    (3, "mpl-1.1", "subject to the mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1", 0.99),
    (3, "mpl-2.0", "mozilla org mpl", "mozilla org mpl 2 0", 0.95),
    (3, "epl-2.0", "available under the terms of the eclipse", "made available under the terms of the eclipse public license(?: v)? 2 0", 0.98),
    (3, "epl-1.0", "available under the terms of the eclipse", "made available under the terms of the eclipse public license(?: v)? 1 0", 0.98),
    (3, "epl", "legal epl", "eclipse org (?:org )?legal epl", 0.93),
    (3, "cddl", "subject to the terms of the common development", "subject to the terms of the common development and distribution license", 0.96),
    (3, "eupl-1.2", "joinup ec europa eu", "joinup ec europa eu (?:[^ ]+ ){0,6}eupl", 0.9),
    (3, "artistic-2.0", "intent of this document", "the intent of this document is to state the conditions under which a package may be copied", 0.85),
    (3, "bsl-1.0", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0.99),
    (3, "busl-1.1", "change date", "the change date or the fourth anniversary of the first publicly available distribution", 0.95),
    (3, "sspl-1.0", "service source code", "the service source code means the corresponding source for the program", 0.9),
    (3, "zlib", "altered source versions", "altered source versions must be plainly marked as such", 0.95),
    (3, "zlib", "must not be misrepresented", "the origin of this software must not be misrepresented", 0.93),
    (3, "openssl", "openssl project", "this product includes software developed by the openssl project", 0.97),
    (3, "php-3.01", "php net license", "php net license 3 01(?: txt)?", 0.93),
    (3, "python-2.0", "psf is making python available", "psf is making python available to licensee on an as is basis", 0.98),
    (3, "unlicense", "anyone is free to copy modify", "anyone is free to copy modify publish use compile sell or distribute this software", 0.98),
    (3, "unlicense", "unlicense org", "unlicense org", 0.9),
    (3, "beerware", "buy me a beer", "you can buy me a beer in return", 0.95),
    (3, "ofl-1.1", "scripts sil org", "scripts sil org ofl", 0.95),
    (3, "ofl-1.1", "font software", "the font software may be (?:modified|sold|bundled) (?:[^ ]+ ){0,8}with any software", 0.8),
    (3, "ncsa", "neither the names of", "neither the names of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    (3, "postgresql", "in no event shall", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages", 0.85),
    (3, "odbl-1.0", "opendatacommons org licenses odbl", "opendatacommons org licenses odbl(?: 1 0)?", 0.97),
    (3, "odc-by-1.0", "opendatacommons org licenses by", "opendatacommons org licenses by(?: 1 0)?", 0.97),
    (3, "pddl-1.0", "opendatacommons org licenses pddl", "opendatacommons org licenses pddl(?: 1 0)?", 0.97),
    (3, "ogl-uk-3.0", "public sector information licensed under", "contains public sector information licensed under the open government licen[cs]e(?: v3 0)?", 0.98),
    (3, "openrail", "use based restrictions", "use based restrictions as referenced in paragraph 5", 0.9),
    (3, "llama", "llama", "llama (?:2|3|3 1|3 2|3 3) (?:community )?license(?: agreement)?", 0.95),
    (3, "llama", "meta platforms", "is licensed under the llama (?:[^ ]+ ){1,4}license copyright (?:c |© ?)?meta platforms", 0.97),
    (3, "gemma", "gemma terms of use", "gemma terms of use", 0.95),
    (3, "cc0-1.0", "waived all copyright", "(?:has|have) waived all copyright and related or neighboring rights", 0.97),
    (3, "cc0-1.0", "no rights reserved", "no rights reserved", 0.6),
    (3, "cc-by-nc", "creative commons noncommercial", "creative commons noncommercial(?: license)?", 0.8),
    (3, "cc-by-sa", "same or similar license", "you may distribute the resulting work only under the same or similar license", 0.9),
    (3, "cc-by", "you must give appropriate credit", "you must give appropriate credit provide a link to the license and indicate if changes were made", 0.95),
    (3, "cc-by-nc", "you may not use the material for commercial", "you may not use the material for commercial purposes", 0.95),
    (3, "cc-by-nd", "you may not distribute the modified material", "if you remix transform or build upon the material you may not distribute the modified material", 0.95),
    (3, "cc-by-sa", "you must distribute your contributions", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", 0.95),
    (3, "creative-commons", "creativecommons org", "(?:https? )?(?:www )?creativecommons org licenses", 0.8),
    (3, "creative-commons", "some rights reserved", "some rights reserved", 0.8),
    (2, "creative-commons", "creative commons", "licen[cs]ed under (?:a |the )?creative commons(?: [^ ]+){0,3}", 0.85),
    (2, "cc-by-sa", "share alike", "(?:text|content|page) is available under the creative commons attribution share alike license", 0.95),
    (3, "stackexchange", "user contributions licensed under", "user contributions licensed under cc by sa", 0.95),
    (3, "wikipedia", "text is available under", "text is available under the creative commons attribution share ?alike license additional terms may apply", 0.97),
    (3, "gutenberg", "project gutenberg", "the project gutenberg (?:ebook|license|literary archive foundation)", 0.95),
    (3, "gutenberg", "no cost and with almost no restrictions", "at no cost and with almost no restrictions whatsoever", 0.9),
    (3, "crown-copyright", "crown copyright", "(?:© )?crown copyright(?: (?:19|20)[0-9][0-9])?", 0.9),
    (3, "us-government", "work of the united states government", "(?:is )?a work of the united states government", 0.9),
    (3, "us-government", "copyright protection", "not subject to copyright protection (?:[^ ]+ ){0,6}title 17", 0.85),
    (2, "public-domain", "public domain", "(?:is|are) in the public domain", 0.9),
    (2, "public-domain", "no known copyright", "no known copyright restrictions", 0.9),
    (2, "public-domain", "copyright has expired", "copyright has expired", 0.8),
    (2, "public-domain", "gemeinfrei", "gemeinfrei(?:e[nrs]?)?", 0.7),
    (2, "public-domain", "domaine public", "(?:dans le )?domaine public", 0.7),
    (2, "public-domain", "dominio p", "(?:de )?dominio p[úÚ]blico", 0.7),
    (2, "reserved", "alle rechte vorbehalten", "alle rechte vorbehalten", 0.9),
    (2, "reserved", "tous droits r", "tous droits r[éÉ]serv[éÉ]s", 0.9),
    (2, "reserved", "todos los derechos reservados", "todos los derechos reservados", 0.9),
    (2, "reserved", "todos os direitos reservados", "todos os direitos reservados", 0.9),
    (2, "reserved", "tutti i diritti riservati", "tutti i diritti riservati", 0.9),
    (2, "reserved", "rights are reserved", "(?:all|any) (?:other )?rights are reserved", 0.8),
    (2, "permission-required", "nachdruck", "nachdruck (?:auch auszugsweise )?(?:nur mit genehmigung|verboten)", 0.8),
    (2, "permission-required", "reproduction interdite", "(?:toute )?reproduction interdite(?: sans autorisation)?", 0.8),
    (2, "permission-required", "prohibida", "(?:queda )?prohibida (?:su |la )?reproducci[óÓ]n(?: total o parcial)?", 0.8),
    (2, "permission-required", "no part of this publication", "no part of this publication may be (?:reproduced|copied|stored|transmitted)", 0.9),
    (2, "permission-required", "no part of this book", "no part of this book may be (?:reproduced|copied|stored|transmitted)", 0.9),
    (2, "permission-required", "no part of this document", "no part of this document may be (?:reproduced|copied|stored|transmitted)", 0.9),
    (2, "permission-required", "no part of this website", "no part of this website may be (?:reproduced|copied|stored|transmitted)", 0.9),
    (2, "permission-required", "without the prior written", "without the prior written (?:permission|consent)", 0.8),
    (2, "permission-required", "without permission", "(?:do not|may not be|not to be) (?:copy|copied|reproduced|reprinted|republished|shared) without permission", 0.85),
    (2, "permission-required", "for permission", "for permission to (?:reprint|reproduce|reuse|republish)", 0.7),
    (2, "permission-required", "reprinted", "reprinted (?:here )?with (?:the )?permission", 0.7),
    (2, "proprietary", "trade secrets", "(?:contains|constitutes) (?:confidential )?(?:information and )?trade secrets", 0.8),
    (2, "proprietary", "internal use only", "for internal use only", 0.85),
    (2, "proprietary", "not for distribution", "not for distribution", 0.75),
    (2, "proprietary", "do not distribute", "(?:please )?do not distribute", 0.7),
    (2, "proprietary", "confidential", "strictly (?:private and )?confidential", 0.7),
    (2, "proprietary", "end user license agreement", "end user license agreement", 0.8),
    (2, "proprietary", "eula", "eula", 0.6),
    (2, "proprietary", "reverse engineer", "(?:you )?(?:may not|shall not|must not) (?:[^ ]+ ){0,6}reverse engineer", 0.8),
    (2, "terms-of-service", "terms of service", "(?:subject to|agree to|under) (?:the |our |these )?terms of service", 0.6),
    (2, "terms-of-service", "terms of use", "(?:subject to|agree to|under) (?:the |our |these )?terms of use", 0.6),
    (2, "terms-of-service", "terms and conditions", "(?:subject to|agree to|accept) (?:the |our |these )?terms and conditions", 0.5),
    (2, "no-scraping", "scrap", "(?:no|not) (?:[^ ]+ ){0,4}(?:scrape|scraping)(?: [^ ]+){0,2}", 0.6),
    (2, "no-ai-training", "train", "(?:not be used|may not be used|do not use|prohibited) (?:[^ ]+ ){0,6}(?:to|for) train(?:ing)? (?:[^ ]+ ){0,3}(?:ai|models?|machine learning)", 0.9),
    (2, "no-ai-training", "text and data mining", "(?:reserves?|reserved|prohibit(?:s|ed)?) (?:[^ ]+ ){0,6}text and data mining", 0.85),
    (2, "non-commercial", "not for commercial use", "not for commercial use", 0.9),
    (2, "non-commercial", "non commercial purposes", "(?:for )?non commercial purposes(?: only)?", 0.8),
    (2, "non-commercial", "noncommercial", "(?:for )?noncommercial (?:use|purposes)(?: only)?", 0.8),
    (2, "non-commercial", "educational", "for educational (?:use|purposes) only", 0.8),
    (2, "non-commercial", "research purposes only", "(?:for )?(?:academic |scientific )?research purposes only", 0.8),
    (2, "non-commercial", "commercial use", "(?:no|without|prohibits|forbids) commercial use", 0.85),
    (2, "non-commercial", "nicht kommerziell", "nicht kommerziell(?:e[nrs]?)?(?: zwecke[n]?)?", 0.7),
    (2, "evaluation-only", "evaluation purposes only", "(?:for )?evaluation purposes only", 0.85),
    (2, "no-derivatives", "modif", "(?:no|without) (?:any )?modifications? (?:is|are )?(?:allowed|permitted)", 0.7),
    (2, "share-alike", "under the same license", "(?:distributed|released|shared|licensed) under the same license", 0.7),
    (2, "attribution", "with attribution", "(?:free to use|may be used|reuse|reproduced) with attribution", 0.7),
    (2, "attribution", "attribution required", "attribution required", 0.7),
    (2, "royalty-free", "royalty free", "royalty free(?: license)?", 0.6),
    (2, "dual-licensed", "dual licen", "dual licen[cs]ed(?: under)?", 0.8),
    (2, "open-source", "open source license", "(?:an |any )?open source license", 0.6),
    (2, "copyleft", "copyleft", "copyleft(?: license)?", 0.6),
    (2, "source-available", "source available", "source available(?: license)?", 0.6),
    (2, "commons-clause", "commons clause", "(?:the )?commons clause(?: license condition)?", 0.9),
    (2, "fair-use", "fair use", "(?:constitutes|under|considered) fair use", 0.5),
    (2, "dmca", "dmca", "dmca(?: notice| takedown| policy)?", 0.5),
    (2, "polyform", "polyform", "polyform (?:noncommercial|small business|perimeter|shield|strict) license", 0.95),
    (2, "hippocratic", "hippocratic license", "hippocratic license(?: 2 1| 3 0)?", 0.95),
    (2, "cecill", "cecill", "cecill(?: [abc])?(?: license)?", 0.85),
    (2, "mulan", "mulan", "mulan (?:psl|permissive software license)(?: v2| v1)?", 0.95),
    (2, "qpl", "q public license", "q public license", 0.9),
    (2, "ipl-1.0", "ibm public license", "ibm public license", 0.9),
    (2, "nasa", "nasa open source agreement", "nasa open source agreement", 0.95),
    (2, "upl-1.0", "universal permissive license", "universal permissive license", 0.95),
    (2, "bigcode", "bigcode", "bigcode open ?rail(?: m)?(?: v1)?", 0.95),
    (2, "etalab", "licence ouverte", "licence ouverte(?: etalab)?", 0.9),
    (2, "dl-de-by", "datenlizenz deutschland", "datenlizenz deutschland(?: namensnennung)?", 0.95),
    (2, "cdla", "community data license agreement", "community data license agreement(?: (?:permissive|sharing))?", 0.95),
    (1, "trademark", "registered trademark", "(?:is|are) (?:a )?registered trademarks?", 0.3),
    (1, "licensed", "licensed under", "licensed under(?: the)?(?: terms of)?(?: the)?", 0.3),
    (1, "reserved", "rights reserved", "rights reserved", 0.4),
    (1, "copyright", "copyright", "copyright © (?:19|20)[0-9][0-9]", 0.5),
    (1, "copyright", "©", "©(?: ?(?:19|20)[0-9][0-9])", 0.5),
]

#: Names of licenses.
MENTIONS: list[Rule] = [
    (2, "agpl-3.0", "agpl", "(?:(?:gnu )?agpl(?: version| v)? ?3(?: 0)?|agplv3)", 0.75),
    (2, "agpl-3.0", "affero general public license", "(?:gnu )?affero general public license,?(?: version| v)? ?3(?: 0)?", 0.75),
    (2, "gpl-1.0", "gpl", "(?:gnu )?gpl ?v?1(?: 0)?", 0.75),
    (2, "gpl-1.0", "general public license", "(?:gnu )?general public license (?:version |v)1", 0.75),
    (2, "gpl-2.0", "gpl", "(?:gnu )?gpl ?v?2(?: 0)?", 0.75),
    (2, "gpl-2.0", "general public license", "(?:gnu )?general public license (?:version |v)2(?: 0)?", 0.75),
    (2, "gpl-3.0", "gpl", "(?:gnu )?gpl ?v?3(?: 0)?", 0.75),
    (2, "gpl-3.0", "general public license", "(?:gnu )?general public license (?:version |v)3(?: 0)?", 0.75),
    (2, "lgpl-2.1", "lgpl", "(?:gnu )?lgpl ?v?2(?: 1)?", 0.75),
    (2, "lgpl-2.1", "lesser general public license", "(?:gnu )?lesser general public license (?:version |v)2(?: 1)?", 0.75),
    (2, "lgpl-3.0", "lgpl", "(?:gnu )?lgpl ?v?3(?: 0)?", 0.75),
    (2, "lgpl-3.0", "lesser general public license", "(?:gnu )?lesser general public license (?:version |v)3(?: 0)?", 0.75),
    (2, "gfdl", "free documentation license", "(?:gnu )?free documentation license(?: (?:version |v)1 [1-3])?", 0.75),
    (2, "gfdl", "gfdl", "(?:gnu )?gfdl", 0.75),
    (2, "apache-1.1", "apache", "apache (?:software )?license (?:version |v)?1 1", 0.75),
    (2, "apache-2.0", "apache", "apache (?:software )?license (?:version |v)?2(?: 0)?", 0.75),
    (2, "apache-2.0", "apache 2 0", "apache 2 0", 0.75),
    (2, "mit", "mit license", "(?:the )?mit license", 0.75),
    (2, "mit", "expat license", "(?:the )?expat license", 0.75),
    (2, "mit", "mit licensed", "mit licensed", 0.75),
    (2, "mit-0", "mit no attribution", "mit no attribution", 0.75),
    (2, "isc", "isc license", "isc license", 0.75),
    (2, "bsd-2-clause", "simplified bsd", "simplified bsd(?: license)?", 0.75),
    (2, "bsd-2-clause", "clause", "(?:bsd 2 clause|2 clause bsd|two clause bsd)(?: license)?", 0.75),
    (2, "bsd-3-clause", "new bsd", "new bsd(?: license)?", 0.75),
    (2, "bsd-3-clause", "modified bsd", "modified bsd(?: license)?", 0.75),
    (2, "bsd-3-clause", "clause", "(?:bsd 3 clause|3 clause bsd|three clause bsd)(?: license)?", 0.75),
    (2, "bsd-4-clause", "original bsd", "original bsd(?: license)?", 0.75),
    (2, "bsd-4-clause", "clause", "(?:bsd 4 clause|4 clause bsd)(?: license)?", 0.75),
    (2, "0bsd", "0bsd", "0bsd(?: license)?", 0.75),
    (2, "0bsd", "zero clause", "(?:zero clause bsd|bsd zero clause)(?: license)?", 0.75),
    (2, "mpl-1.1", "mpl", "mpl(?: version| v)? 1 1", 0.75),
    (2, "mpl-1.1", "mozilla public license", "mozilla public license(?: version| v)? 1 1", 0.75),
    (2, "mpl-2.0", "mpl", "mpl(?: version| v)? 2(?: 0)?", 0.75),
    (2, "mpl-2.0", "mozilla public license", "mozilla public license(?: version| v)? 2(?: 0)?", 0.75),
    (2, "epl-1.0", "epl", "epl(?: version| v)? 1 0", 0.75),
    (2, "epl-1.0", "eclipse public license", "eclipse public license(?: version| v)? 1 0", 0.75),
    (2, "epl-2.0", "epl", "epl(?: version| v)? 2 0", 0.75),
    (2, "epl-2.0", "eclipse public license", "eclipse public license(?: version| v)? 2 0", 0.75),
    (2, "eupl-1.2", "european union public licen", "european union public licen[cs]e(?: version| v)?(?: 1 2)?", 0.75),
    (2, "eupl-1.2", "eupl", "eupl(?: version| v)?(?: 1 2)?", 0.75),
    (2, "cddl-1.0", "common development and distribution license", "common development and distribution license(?: version| v)? 1 0", 0.75),
    (2, "cddl-1.1", "common development and distribution license", "common development and distribution license(?: version| v)? 1 1", 0.75),
    (2, "cddl", "cddl", "cddl(?: 1 [01])?", 0.75),
    (2, "cpl-1.0", "common public license", "common public license(?: version| v)? 1 0", 0.75),
    (2, "artistic-1.0", "artistic license", "artistic license(?: version| v)? 1 0", 0.75),
    (2, "artistic-2.0", "artistic license", "artistic license(?: version| v)? 2 0", 0.75),
    (2, "bsl-1.0", "boost software license", "boost software license(?: version| v)?(?: 1 0)?", 0.75),
    (2, "busl-1.1", "business source license", "business source license(?: version| v)?(?: 1 1)?", 0.75),
    (2, "sspl-1.0", "server side public license", "server side public license(?: version| v)?(?: 1)?", 0.75),
    (2, "elastic-2.0", "elastic license", "elastic license(?: version| v)? 2(?: 0)?", 0.75),
    (2, "zlib", "zlib", "zlib(?: libpng)? license", 0.75),
    (2, "zlib", "libpng license", "libpng license", 0.75),
    (2, "curl", "curl license", "curl license", 0.75),
    (2, "openssl", "openssl license", "openssl license", 0.75),
    (2, "php-3.01", "php license", "php license(?: version| v)?(?: 3 01)?", 0.75),
    (2, "python-2.0", "python software foundation license", "python software foundation license(?: version| v)?(?: 2)?", 0.75),
    (2, "python-2.0", "psf license", "psf license", 0.75),
    (2, "ruby", "ruby license", "ruby license", 0.75),
    (2, "vim", "vim license", "vim license", 0.75),
    (2, "wtfpl", "you want to public license", "do what the (?:fuck|f) you want to public license", 0.75),
    (2, "wtfpl", "wtfpl", "wtfpl", 0.75),
    (2, "unlicense", "the unlicense", "the unlicense", 0.75),
    (2, "beerware", "beerware", "beerware(?: license)?", 0.75),
    (2, "ofl-1.1", "open font license", "(?:sil )?open font license(?: version| v)?(?: 1 1)?", 0.75),
    (2, "ms-pl", "microsoft public license", "microsoft public license", 0.75),
    (2, "ms-rl", "microsoft reciprocal license", "microsoft reciprocal license", 0.75),
    (2, "ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? license", 0.75),
    (2, "postgresql", "postgresql license", "postgresql license", 0.75),
    (2, "odbl-1.0", "open database license", "open database license", 0.75),
    (2, "odbl-1.0", "odbl", "odbl", 0.75),
    (2, "odc-by-1.0", "open data commons attribution license", "open data commons attribution license", 0.75),
    (2, "odc-by-1.0", "odc by", "odc by(?: 1 0)?", 0.75),
    (2, "pddl-1.0", "public domain dedication and license", "public domain dedication and license", 0.75),
    (2, "pddl-1.0", "pddl", "pddl", 0.75),
    (2, "ogl-uk-3.0", "open government licen", "open government licen[cs]e(?: v)?(?: ?3 0)?", 0.75),
    (2, "openrail", "openrail", "(?:creativeml )?openrail(?: m)?(?: license)?", 0.75),
    (2, "openrail", "open rail", "(?:creativeml )?open rail(?: m)?(?: license)?", 0.75),
    (2, "cc0-1.0", "cc0", "cc0(?: 1 0)?", 0.75),
    (2, "cc0-1.0", "cc zero", "cc zero", 0.75),
    (2, "cc0-1.0", "creative commons zero", "creative commons zero", 0.75),
    (2, "cc-by-4.0", "cc by 4 0", "cc by 4 0", 0.75),
    (2, "cc-by-4.0", "creative commons attribution 4 0", "creative commons attribution 4 0(?: international)?", 0.75),
    (2, "cc-by-3.0", "cc by 3 0", "cc by 3 0", 0.75),
    (2, "cc-by-3.0", "creative commons attribution 3 0", "creative commons attribution 3 0(?: unported)?", 0.75),
    (2, "cc-by-2.0", "cc by 2 0", "cc by 2 0", 0.75),
    (2, "cc-by-2.0", "creative commons attribution 2 0", "creative commons attribution 2 0", 0.75),
    (2, "cc-by-sa", "cc by sa", "cc by sa(?: [1-4] [05])?", 0.75),
    (2, "cc-by-sa", "creative commons attribution share", "creative commons attribution share ?alike(?: [1-4] [05])?", 0.75),
    (2, "cc-by-nc", "cc by nc", "cc by nc(?: [1-4] [05])?", 0.75),
    (2, "cc-by-nc", "creative commons attribution non", "creative commons attribution non ?commercial(?: [1-4] [05])?", 0.75),
    (2, "cc-by-nd", "cc by nd", "cc by nd(?: [1-4] [05])?", 0.75),
    (2, "cc-by-nd", "creative commons attribution no", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?", 0.75),
    (2, "cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4] [05])?", 0.75),
    (2, "cc-by-nc-sa", "creative commons attribution non", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", 0.75),
    (2, "cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4] [05])?", 0.75),
    (2, "cc-by-nc-nd", "creative commons attribution non", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?", 0.75),
]

#: Verbs that open a grant of a named license.
GRANT = "(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?"


def rules() -> list[Rule]:
    """All rules; of equal detections the first one wins. A tag for each label, and a grant for each name, come from the names."""
    labels = dict.fromkeys(label for _, label, *_ in MENTIONS)
    tags = [(3, label, "spdx license identifier", f"spdx license identifier {label.replace('-', ' ').replace('.', ' ')}(?: only| or later)?", 1.0) for label in labels]
    grants = [(3, label, keyword, f"{GRANT}(?:{pattern})", 0.95) for _, label, keyword, pattern, _ in MENTIONS]
    return [*tags, *STATEMENTS, *grants, *MENTIONS]
