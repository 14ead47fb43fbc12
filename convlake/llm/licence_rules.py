"""The signature rules of the licence scan, over the form of words: lower case, one space between words.

A signature is label, gates (phrases that must all stand in the text, joined by `&`; alternatives by `|`) and a pattern.
Gates are a prefilter: every text that the pattern fits has them.
"""

from __future__ import annotations

# Base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# Some words, as a name stands in a licence.
SOME = "(?:[^ ]+ ){1,12}?"

# Notices and bodies of licences, written out one by one.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", " shall be included in all copies or substantial", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "merchantability fitness for a particular purpose and non", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement"),
    ("mit", "mit style licen", "(?:under|using)(?: an?| the)? mit style licen[cs]e"),
    ("mit", " mit licen| mit open source licen&released under", "released under(?: the)?(?: terms of the)? mit(?: open source)? licen[cs]e"),
    ("mit-0", "mit no attribution", "mit no attribution(?: licen[cs]e)?"),
    ("x11", "shall not be used in advertising", "except as contained in this notice the names? of (?:the )?" + SOME + "shall not be used in advertising or otherwise to promote the sale"),
    ("mit-modern-variant", "modern variant of the mit", "modern variant of the mit licen[cs]e"),
    ("json", "shall be used for good not evil", "the software shall be used for good not evil"),
    ("isc", "for any purpose with or without fee is hereby granted provided", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "for any purpose with or without fee is hereby granted the software", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", "disclaims all warranties with regard", "the software is provided as is and(?: the)? " + SOME + "disclaims all warranties with regard to this software"),
    ("hpnd", "this software and its documentation for any purpose is hereby granted without fee", "permission to use copy modify and distribute this software and its documentation for any purpose is hereby granted without fee"),
    ("hpnd", "used in advertising or publicity", "not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("postgresql", "without fee and without a written agreement is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "any express or implied warranties", "this software is provided by (?:the )?" + SOME + "as is and any express or implied warranties"),
    ("bsd-3-clause", "endorse or promote products derived from this software", "neither the names? of (?:the )?" + SOME + "nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "may not be used to endorse or promote products", "the names? of (?:the )?" + SOME + "may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials mentioning features", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause-uc", "developed by the university of california", "this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-views", "should not be interpreted as representing official policies", "those of the authors and should not be interpreted as representing official policies"),
    ("bsd", "bsd style licen", "(?:under|by) an? bsd style licen[cs]e"),
    ("apache-2.0", "use this file except in compliance with the license", "licensed under the apache licen[cs]e version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "software distributed under the license is distributed on an as is basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "apache org licenses license 2 0", "(?:you may obtain a copy of the license at )?https? (?:www )?apache org licenses license 2 0(?: html| txt)?"),
    ("apache-2.0", "apache license version 2 0 january 2004", "apache license version 2 0 january 2004"),
    ("apache-2.0", "licensed to the apache software foundation", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "terms and conditions for use reproduction and distribution", "terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache-1.1", "developed by the apache software foundation", "this product includes software developed by the apache software foundation"),
    ("gpl", "terms of the gnu general public licen&as published by the free", "free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("gpl-1.0", "version 1 of the license|version 1 0 of the license", "gnu general public licen[cs]e as published by the free software foundation (?:either )?version 1(?: 0)? of the license(?: or(?: at your option)? any later version)?"),
    ("gpl-2.0", "version 2 of the license|version 2 0 of the license", "gnu general public licen[cs]e as published by the free software foundation (?:either )?version 2(?: 0)? of the license(?: or(?: at your option)? any later version)?"),
    ("gpl-3.0", "version 3 of the license|version 3 0 of the license", "gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3(?: 0)? of the license(?: or(?: at your option)? any later version)?"),
    ("gpl-2.0", "general public license version 2 as published|general public licence version 2 as published", "gnu general public licen[cs]e version 2 as published by the free software foundation"),
    ("gpl-3.0", "general public license version 3 as published|general public licence version 3 as published", "gnu general public licen[cs]e version 3 as published by the free software foundation"),
    ("gpl", "distributed in the hope that it will be useful", "(?:program|software|file) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "received a copy of the gnu general", "you should have received a copy of the gnu general public licen[cs]e along with this"),
    ("gpl-2.0", "general public license version 2 june 1991", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "general public license version 3 29 june 2007", "gnu general public license version 3 29 june 2007"),
    ("gpl-1.0", "general public license version 1 february 1989", "gnu general public license version 1 february 1989"),
    ("gpl", "copy and distribute verbatim copies of this license document", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "the gnu general public license is a free copyleft license", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-exception-classpath", "linking this library statically or dynamically", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-exception-autoconf", "this file as part of a program that contains a configuration script", "if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("gpl-exception-gcc", "gcc runtime library exception", "gcc runtime library exception(?: version 3 1)?"),
    ("gpl-exception-openssl", "permission to link the code of", "gives? permission to link the code of " + SOME + "with the openssl library"),
    ("lgpl", "lesser general public licen|library general public licen&as published by the free", "free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation"),
    ("lgpl-2.1", "version 2 1 of the license", "gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 2 1 of the license(?: or(?: at your option)? any later version)?"),
    ("lgpl-3.0", "version 3 of the license|version 3 0 of the license", "gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 3(?: 0)? of the license(?: or(?: at your option)? any later version)?"),
    ("lgpl-2.0", "version 2 of the license", "gnu library general public licen[cs]e as published by the free software foundation (?:either )?version 2 of the license(?: or(?: at your option)? any later version)?"),
    ("lgpl", "received a copy of the gnu lesser|received a copy of the gnu library", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this"),
    ("lgpl-2.1", "general public license version 2 1 february 1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "lesser general public license version 3 29 june 2007", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl", "affero general public licen&as published by the free", "free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation"),
    ("agpl-3.0", "version 3 of the license", "gnu affero general public licen[cs]e as published by the free software foundation (?:either )?version 3 of the license(?: or(?: at your option)? any later version)?"),
    ("agpl", "received a copy of the gnu affero", "you should have received a copy of the gnu affero general public licen[cs]e along with this"),
    ("agpl-3.0", "affero general public license version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("gfdl", "modify this document under the terms of the gnu free", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", "no front cover texts", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "subject to the terms of the mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "contents of this file are subject to the mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "contents of this file are subject to the mozilla public license version 1 0", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-2.0", "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses as defined by the mozilla public licen[cs]e"),
    ("npl-1.1", "netscape public licen", "netscape public licen[cs]e(?: version 1 1)?"),
    ("epl-1.0", "made available under the terms of the eclipse public licen", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v ?1 0"),
    ("epl-2.0", "made available under the terms of the eclipse public licen", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v ?)?2 0"),
    ("edl-1.0", "eclipse distribution licen", "eclipse distribution licen[cs]e(?: v ?1 0)?"),
    ("cddl", "common development and distribution license", "the contents of this file are subject to the terms of (?:either )?(?:the )?common development and distribution license"),
    ("cpl-1.0", "terms of the common public licen", "(?:made available|licensed) under the terms of the common public licen[cs]e(?: v ?1 0)?"),
    ("ipl-1.0", "ibm public licen", "ibm public licen[cs]e(?: version 1 0)?"),
    ("unlicense", "this is free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", "waived all copyright", "to the extent possible under law (?:the )?" + SOME + "waived all copyright and related or neighbou?ring rights"),
    ("cc0-1.0", " cc0 1 0 universal", "(?:creative commons )?cc0 1 0 universal(?: public domain dedication)?"),
    ("cc0-1.0", "creativecommons org publicdomain zero", "https? (?:www )?creativecommons org publicdomain zero 1 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0", "(?:work|content|text) is licensed under a creative commons attribution 4 0 international licen[cs]e"),
    ("cc-by-3.0", "licensed under a creative commons attribution 3 0", "(?:work|content|text) is licensed under a creative commons attribution 3 0(?: unported)? licen[cs]e"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution share", "(?:work|content|text) is licensed under a creative commons attribution share ?alike 4 0 international licen[cs]e"),
    ("cc-by-sa-3.0", "creative commons attribution share", "available under the creative commons attribution share ?alike (?:3 0 )?licen[cs]e"),
    ("cc-by", "creativecommons org licenses by ", "https? (?:www )?creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org licenses by sa", "https? (?:www )?creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons org licenses by nc", "https? (?:www )?creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons org licenses by nd", "https? (?:www )?creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "https? (?:www )?creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "https? (?:www )?creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-pdm", "public domain mark", "public domain mark(?: 1 0)?"),
    ("wtfpl", "what the fuck you want to", "do what the fuck you want to public licen[cs]e"),
    ("wtfpl", "you just do what the fuck", "you just do what the fuck you want to"),
    ("zlib", "in no event will the authors be held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "origin of this software must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "png reference library", "png reference library licen[cs]e(?: version 2)?"),
    ("bsl-1.0", "any person or organization obtaining a copy of the software", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", "boost org license 1 0", "(?:see accompanying file license 1 0 txt or copy at )?https? www boost org license 1 0 txt"),
    ("artistic", "conditions under which a package may be copied", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "the artistic license 2 0", "the artistic license 2 0"),
    ("perl", "same terms as perl itself", "(?:library|program|module|software) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl itself"),
    ("perl", "under the same terms as perl", "under the same terms as perl(?: 5)?(?: itself)?"),
    ("ruby", "under the same terms as ruby", "under the same terms as ruby(?: itself)?"),
    ("ruby", "ruby licen", "ruby licen[cs]e"),
    ("psf-2.0", "making python available to licensee", "psf is making python available to licensee on an as is basis"),
    ("psf-2.0", "python software foundation license version 2", "python software foundation license version 2"),
    ("openssl", "developed by the openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic software written by eric young", "this product includes cryptographic software written by eric young"),
    ("ofl-1.1", "font software is licensed under the sil", "this font software is licensed under the sil open font licen[cs]e version 1 1"),
    ("ofl-1.1", "reserved font name", "with reserved font name"),
    ("bitstream-vera", "copy of the fonts accompanying this license", "permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license"),
    ("ubuntu-font-1.0", "ubuntu font licen", "ubuntu font licen[cs]e(?: version 1 0)?"),
    ("ipa-font", "ipa font licen", "ipa font licen[cs]e agreement(?: v1 0)?"),
    ("lppl", "under the conditions of the latex project public", "this work may be distributed and or modified under the conditions of the latex project public licen[cs]e"),
    ("lppl", "lppl maintenance status", "this work has the lppl maintenance status"),
    ("ncsa", "deal with the software without restriction", "to deal with the software without restriction"),
    ("unicode", "copy of the unicode data files", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("unicode", "unicode inc license agreement", "unicode inc license agreement data files and software"),
    ("icu", "icu licen", "icu licen[cs]e icu 1 8 1 and later"),
    ("w3c", "w3c software", "w3c software (?:and document )?(?:notice and )?licen[cs]e"),
    ("w3c", "copying this work you the licensee agree", "by obtaining(?: using)? and or copying this work you the licensee agree that you have read understood"),
    ("beerware", "you can do whatever you want with this stuff", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("beerware", "buy me a beer in return", "you can buy me a beer in return"),
    ("vim", "vim is charityware", "vim is charityware you can use and copy it as much as you like"),
    ("ftl", "copyright the freetype project|the freetype project", "portions of this software are copyright " + SOME + "the freetype project"),
    ("ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("libtiff", "sam leffler and silicon graphics", "the names of sam leffler and silicon graphics may not be used in any advertising"),
    ("curl", "name of a copyright holder shall not be used in advertising", "except as contained in this notice the name of a copyright holder shall not be used in advertising"),
    ("ntp", "university of delaware makes no representations", "the university of delaware makes no representations about the suitability"),
    ("sleepycat", "how to obtain complete source code", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("cecill", "governed by the cecill", "this software is governed by the cecill(?: b| c)? licen[cs]e under french law"),
    ("cecill", "cecill free software license", "cecill free software license agreement"),
    ("eupl", "licensed under the eupl", "licensed under the eupl(?: version| v)? ?1 [012]"),
    ("ms-pl", "this license governs use of the accompanying software", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-limited", "microsoft software license terms", "microsoft software license terms"),
    ("sspl-1.0", "functionality of the program or a modified version available to third parties as a service", "make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "make non production use of the licensed work", "the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl", "business source license", "the business source license this document or the license is not an open source license"),
    ("elastic-2.0", "third parties as a hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause license condition", "commons clause license condition(?: v1 0)?"),
    ("commons-clause", "the right to sell the software", "the license does not include(?: and the license does not grant to you)? the right to sell the software"),
    ("polyform", "polyform noncommercial|polyform small business|polyform shield|polyform strict|polyform perimeter", "polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e(?: 1 0 [01])?"),
    ("prosperity", "prosperity public licen", "(?:the )?prosperity public licen[cs]e(?: 3 0 0)?"),
    ("blueoak-1.0.0", "blue oak model licen", "blue oak model licen[cs]e(?: version)?(?: 1 0 0)?"),
    ("upl-1.0", "universal permissive licen", "(?:the )?universal permissive licen[cs]e(?: upl)?(?: version 1 0)?"),
    ("cal-1.0", "cryptographic autonomy licen", "cryptographic autonomy licen[cs]e(?: version 1 0)?"),
    ("mulanpsl-2.0", "mulan psl v2|mulan permissive software licen", "mulan (?:psl v2|permissive software licen[cs]e(?: version 2)?)"),
    ("qpl-1.0", "q public licen", "(?:the )?q public licen[cs]e(?: version 1 0)?"),
    ("rpl-1.5", "reciprocal public licen", "reciprocal public licen[cs]e(?: 1 5)?"),
    ("nasa-1.3", "nasa open source agreement", "nasa open source agreement(?: version 1 3)?"),
    ("ecl-2.0", "educational community licen", "educational community licen[cs]e(?: version 2 0)?"),
    ("apsl-2.0", "apple public source licen", "apple public source licen[cs]e(?: version)?(?: 2 0)?"),
    ("spl-1.0", "sun public licen", "sun public licen[cs]e(?: version 1 0)?"),
    ("sissl", "sun industry standards source licen", "sun industry standards source licen[cs]e"),
    ("watcom-1.0", "sybase open watcom public licen", "sybase open watcom public licen[cs]e"),
    ("intel", "intel open source licen|intel simplified software licen", "intel (?:open source|simplified software) licen[cs]e"),
    ("nvidia", "nvidia software license agreement|nvidia cuda toolkit", "nvidia (?:software license agreement|cuda toolkit end user license agreement)"),
    ("llama-community", "llama 2 community licen|llama 3 community licen", "llama [23](?: [0-9])? community licen[cs]e(?: agreement)?"),
    ("openrail", " openrail", "(?:creativeml |bigscience |bigcode )?openrail ?[ms]?(?: licen[cs]e)?"),
    ("odbl-1.0", "made available under the open database", "(?:is )?made available under the open database licen[cs]e"),
    ("odc-by-1.0", "open data commons attribution", "open data commons attribution licen[cs]e(?: v1 0)?"),
    ("pddl-1.0", "public domain dedication and licen", "(?:open data commons )?public domain dedication and licen[cs]e(?: pddl)?"),
    ("cdla", "community data license agreement", "community data license agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?"),
    ("ogl-uk", "open government licen", "(?:contains public sector information licensed under the )?open government licen[cs]e(?: v ?[123] 0)?"),
    ("etalab-2.0", "licence ouverte", "licence ouverte(?: open licence)?(?: version 2 0)?"),
    ("dl-de-by-2.0", "datenlizenz deutschland", "datenlizenz deutschland (?:namensnennung|zero)(?: version 2 0)?"),
    ("osm", "openstreetmap contributors", "openstreetmap contributors(?: odbl)?"),
    ("public-domain", "released into the public domain", "(?:is|are|been|hereby) released into the public domain"),
    ("public-domain", "dedicated to the public domain|dedicate any and all copyright interest", "(?:is|are|been|hereby) dedicated to the public domain|dedicate any and all copyright interest in the software to the public domain"),
    ("public-domain", "placed in the public domain", "(?:is|are|been|hereby) placed in the public domain"),
    ("public-domain", "no copyright is claimed", "no copyright is claimed(?: in the united states)?"),
    ("public-domain", "not subject to copyright protection", "(?:is )?not subject to copyright protection(?: in the united states)?"),
    ("dual", "dual licensed under", "(?:is |are )?dual licensed under"),
    ("dual", "at your option this file may not be copied", "at your option this file may not be copied modified or distributed except according to those terms"),
    ("proprietary", "unauthorized copying of this", "unauthorized copying of this (?:file|software) via any medium is strictly prohibited"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", "confidential and proprietary", "confidential and proprietary"),
    ("proprietary", "may be reproduced", "no part of this (?:publication|document|book|work|material) may be reproduced"),
    ("proprietary", "end user license agreement", "end user license agreement(?: eula)?"),
    ("proprietary", "licensed not sold", "(?:software|product) is licensed not sold"),
    ("proprietary", "without the prior written permission of the", "without the prior written permission of the (?:publisher|copyright (?:holder|owner)s?)"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("non-commercial", "for non commercial use only|for noncommercial use only|for personal use only", "for (?:non ?commercial|personal) use only"),
    ("research-only", "for research purposes only|for academic use only", "for (?:research purposes|academic use) only"),
]

# Families: label, keywords (any), pattern of the name, versions as words. Each name and version is put into the same few
# patterns: with its version, licensed or distributed under it, as an SPDX identifier, and alone.
FAMILIES = [
    ("gpl", "general public licen| gpl", "(?:gnu )?(?:general public licen[cs]e|gpl)", ["1 0", "2 0", "3 0", "1", "2", "3"]),
    ("lgpl", "er general public licen|ry general public licen| lgpl", "(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl)", ["2 0", "2 1", "3 0", "2", "3"]),
    ("agpl", "affero general public licen| agpl", "(?:gnu )?(?:affero general public licen[cs]e|agpl)", ["1 0", "3 0", "1", "3"]),
    ("gfdl", "free documentation licen| gfdl", "(?:gnu )?(?:free documentation licen[cs]e|gfdl)", ["1 1", "1 2", "1 3"]),
    ("apache", " apache", "apache(?: software)?(?: licen[cs]e)?", ["1 0", "1 1", "2 0", "2"]),
    ("mpl", " mozilla public licen| mpl", "(?:mozilla public licen[cs]e|mpl)", ["1 0", "1 1", "2 0", "2"]),
    ("epl", " eclipse public licen| epl", "(?:eclipse public licen[cs]e|epl)", ["1 0", "2 0"]),
    ("eupl", " european union public licen| eupl", "(?:european union public licen[cs]e|eupl)", ["1 0", "1 1", "1 2"]),
    ("cddl", " common development and distribution licen| cddl", "(?:common development and distribution licen[cs]e|cddl)", ["1 0", "1 1"]),
    ("cpl", " common public licen", "common public licen[cs]e", ["1 0"]),
    ("artistic", " artistic licen", "artistic licen[cs]e", ["1 0", "2 0"]),
    ("bsl", " boost software licen", "boost software licen[cs]e", ["1 0"]),
    ("busl", " business source licen", "business source licen[cs]e", ["1 0", "1 1"]),
    ("sspl", " server side public licen| sspl", "(?:server side public licen[cs]e|sspl)", ["1"]),
    ("elastic", " elastic licen", "elastic licen[cs]e", ["1 0", "2 0"]),
    ("osl", " open software licen", "open software licen[cs]e", ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", " academic free licen", "academic free licen[cs]e", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("ofl", " open font licen", "(?:sil )?open font licen[cs]e", ["1 0", "1 1"]),
    ("odbl", " open database licen", "open database licen[cs]e", ["1 0"]),
    ("lppl", " latex project public licen", "latex project public licen[cs]e", ["1 0", "1 1", "1 2", "1 3"]),
    ("psf", " python licen| python software foundation licen", "python(?: software foundation)? licen[cs]e", ["2", "2 0"]),
    ("zpl", " zope public licen", "zope public licen[cs]e", ["1 1", "2 0", "2 1"]),
    ("cc-by", " cc by| creative commons ", "(?:cc by|creative commons attribution)", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", " cc by sa| creative commons ", "(?:cc by sa|creative commons attribution share ?alike)", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", " cc by nc| creative commons ", "(?:cc by nc|creative commons attribution non ?commercial)", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", " cc by nd| creative commons ", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", " cc by nc sa| creative commons ", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", " cc by nc nd| creative commons ", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc0", " cc0| cc zero| creative commons zero", "(?:cc0|cc zero|creative commons zero)", ["1 0"]),
    ("mit", " mit licen| expat licen", "(?:mit|expat)(?: licen[cs]e)", []),
    ("x11", " x11 licen", "x11 licen[cs]e", []),
    ("bsd", " bsd ", "bsd(?: style)? licen[cs]e", []),
    ("bsd-2-clause", " bsd ", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)(?: licen[cs]e)?", []),
    ("bsd-3-clause", " bsd ", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|revised|modified) bsd)(?: licen[cs]e)?", []),
    ("bsd-4-clause", " bsd ", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?", []),
    ("0bsd", " 0bsd | bsd ", "(?:0bsd|bsd zero clause|zero clause bsd)(?: licen[cs]e)?", []),
    ("isc", " isc licen", "isc licen[cs]e", []),
    ("zlib", " zlib licen| zlib libpng licen", "zlib(?: libpng)? licen[cs]e", []),
    ("unlicense", " unlicense ", "(?:the )?unlicense", []),
    ("wtfpl", " wtfpl ", "wtfpl", []),
    ("openssl", " openssl licen", "openssl licen[cs]e", []),
    ("ncsa", " ncsa licen| ncsa open source licen", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", []),
    ("postgresql", " postgresql licen", "postgresql licen[cs]e", []),
    ("ms-pl", " microsoft public licen", "microsoft public licen[cs]e", []),
    ("ms-rl", " microsoft reciprocal licen", "microsoft reciprocal licen[cs]e", []),
    ("public-domain", " public domain ", "(?:in|into|to) the public domain", []),
]

# Words of which every gate has one: a text without any is tried no further. Names stand with a version behind them, too.
WORDS = (
    "california license licence licenses licensed licenced licensee licencing licensing copyright permission redistribution redistributions warranties warranty merchantability gnu mit apache bsd 0bsd "
    "creative creativecommons domain reserved openssl mozilla eclipse netscape software freely affero advertising evil fee endorse berkeley official parties asf distributed free hope received "
    "verbatim statically configuration gcc invariant modify mpl secondary ibm unencumbered anyone waived zero fuck liable misrepresented plainly png organization boost package artistic perl "
    "ruby python psf eric font fonts sil unicode icu w3c stuff beer charityware freetype jpeg leffler delaware complete cecill eupl service functionality hosted commons sell polyform "
    "prosperity permissive mulan reciprocal nasa openrail database openstreetmap datenlizenz deutschland ouverte copied proprietary confidential reproduced sold publisher commercial "
    "noncommercial personal research academic unauthorized nvidia cuda llama lppl latex wtfpl unlicense documentation cc0 cc included covers cover texts use"
).split()
NAMES = "gpl lgpl agpl gfdl mpl epl eupl cddl sspl apache license licence cc0".split()
VERSIONED_WORDS = {n: [n] + [f"{n}{v}{k}" for v in ("", "v") for k in range(1, 5)] for n in NAMES} | {"openrail": ["openrail", "openrailm", "openrails"]}


def anchors(phrase: str) -> list[str]:
    """Whole words of which any text with the phrase has one; the phrase may end inside a word."""
    first, *rest = phrase.split()
    if not rest and phrase.startswith(" ") and not phrase.endswith(" "):
        return VERSIONED_WORDS.get(first, [first])
    # The rarest is taken for the longest.
    whole = [w for w in phrase.split() if w in WORDS]
    if whole:
        best = max(whole, key=len)
        return VERSIONED_WORDS.get(best, [best])
    return VERSIONED_WORDS["license"] + VERSIONED_WORDS["licence"] if phrase.endswith("licen") else []


#: The priority of an interval: a notice, a name with its version, a name.
NOTICE, VERSIONED, NAMED = 1, 2, 3


def rules() -> list[dict]:
    """All rules in order: rank, base, prio, label, anchors (words, any), gates (all of which must be met, each by any of its phrases) and pattern."""
    found = [("base", NAMED, label, f" {phrase} ", phrase) for phrase, label in BASE]
    found += [("own", NOTICE, label, gate, pattern) for label, gate, pattern in NOTICES]
    suffix = "(?: or(?: at your option)?(?: any)? later(?: version)?| only)?"
    for label, keyword, name, versions in FAMILIES:
        spdx_name, under = label.replace("-", " "), "(?:licensed|distributed|released|available) under(?: the)?(?: terms of the)?"
        for v in versions:
            whole = v if " " in v or not label.startswith(("gpl", "lgpl", "agpl", "apache", "psf", "mpl")) else f"{v} 0"
            number = f"{name}(?: licen[cs]e| international| unported| generic)*(?: version| ver| v)? ?v? ?{v}(?! ?0)"
            spdx = f"{label}-{whole.replace(' ', '.')}"
            found.append(("own", VERSIONED, spdx, keyword, number + suffix))
            found.append(("own", NOTICE, spdx, f"{keyword}& under ", f"{under} {number}{suffix}"))
            if v == whole:
                found.append(("own", NOTICE, spdx, " spdx license identifier ", f"spdx license identifier (?:gnu )?{spdx_name} {v}{suffix}"))
        found.append(("own", NAMED, label, keyword, name))
        found.append(("own", NOTICE, label, f"{keyword}& under ", f"{under} {name}"))
        found.append(("own", NOTICE, label, " spdx license identifier ", f"spdx license identifier {spdx_name}"))
    return [
        dict(
            rank=k, base=kind == "base", prio=prio, label=label, anchors=sorted({w for p in gate.split("&")[0].split("|") for w in anchors(p)}),
            gates=[g.split("|") for g in gate.split("&")], pattern=f"(?<= )(?:{pattern})(?= )",
        )
        for k, (kind, prio, label, gate, pattern) in enumerate(found)
    ]
