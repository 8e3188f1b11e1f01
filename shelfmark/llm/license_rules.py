r"""Hand-written signatures of license texts, grants, headers and names.

Per line: label (with its version where the wording tells it), priority, keyword, pattern. A blank in
a pattern stands for any run of characters that are not part of words; patterns are matched at word
limits in text lower-cased for A-Z. The keyword is part of every match. Priority 3 is wording that
only one license has, 2 a grant or header that names one, 1 a clause shared within a family, 0 a
notice without a license. A label that ends in ``*`` takes the last number of the match as version.
"""

# Wording of public license texts.
SIGNATURES = (
    # permissive texts of the MIT and ISC kind
    ("mit", 3, "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?"),
    ("mit", 2, "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 2, "substantial", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions"),
    ("mit", 1, "included", r"the above copyright notice and this permission notice shall be included"),
    ("mit", 1, "sublicense", r"rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-0", 3, "attribution", r"mit license no attribution"),
    ("mit", 2, "x11", r"(?:mit x11|x11 mit) licen[cs]e"),
    ("mit", 2, "mit", r"(?:dual )?licensed under (?:the )?mit"),
    ("mit", 2, "mit", r"mit style licen[cs]e(?: that can be found)?"),
    ("mit-modern-variant", 3, "hereby", r"permission is hereby granted without written agreement and without license or royalty fees"),
    ("isc", 3, "purpose", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 2, "purpose", r"permission to use copy modify and or distribute this software for any purpose"),
    ("0bsd", 3, "purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", 3, "supporting", r"both that copyright notice and this permission notice appear in supporting documentation"),
    ("hpnd", 3, "publicity", r"not be used in advertising or publicity pertaining to distribution of the software without specific"),
    ("hpnd", 2, "documentation", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose"),
    ("ntp", 3, "suitability", r"makes no representations about the suitability(?: of)? this software for any purpose"),
    ("curl", 3, "curl", r"copyright c [0-9]+(?: [0-9]+)? daniel stenberg.{0,80}curl"),
    ("postgresql", 2, "postgresql", r"(?:released|licensed|available) under the postgresql licen[cs]e"),
    ("icu", 3, "icu", r"icu license icu [0-9.]+ and later"),
    ("unicode", 3, "unicode", r"copies of the unicode data files or software"),
    ("ncsa", 3, "illinois", r"university of illinois ncsa open source licen[cs]e"),
    ("ncsa", 3, "deal", r"to deal with the software without restriction"),
    # the BSD texts
    ("bsd", 2, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 1, "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd", 1, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 1, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 3, "neither", r"neither the names? of (?:the copyright holders?|the authors?|the university) nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", 3, "neither", r"neither the name of .{1,60} nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", 3, "patent", r"no express or implied licenses to any party s patent rights are granted"),
    ("bsd-4-clause", 3, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-4-clause-uc", 3, "berkeley", r"this product includes software developed by the university of california berkeley"),
    ("bsd-3-clause", 2, "clause", r"(?:3|three) clause bsd(?: style)? licen[cs]e"),
    ("bsd-3-clause", 2, "bsd", r"(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd-2-clause", 2, "clause", r"(?:2|two) clause bsd(?: style)? licen[cs]e"),
    ("bsd-2-clause", 2, "bsd", r"(?:simplified bsd|freebsd) licen[cs]e"),
    ("bsd-4-clause", 2, "bsd", r"(?:4 clause|four clause|original) bsd licen[cs]e"),
    ("0bsd", 2, "bsd", r"(?:zero clause bsd|bsd zero clause|0 clause bsd) licen[cs]e"),
    ("bsd", 2, "bsd", r"bsd style licen[cs]e(?: that can be found)?"),
    # Apache
    ("apache-2.0", 3, "apache", r"licensed under the apache license version 2(?:\.0)? the license"),
    ("apache-2.0", 3, "apache", r"apache license version 2(?:\.0)? january 2004"),
    ("apache-2.0", 2, "apache", r"https? www\.apache\.org licenses license 2\.0"),
    ("apache-2.0", 2, "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2.0", 3, "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: copyright licen[cs]e| except as stated in this section patent licen[cs]e)"),
    ("apache-1.1", 3, "apache", r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", 3, "apache", r"the apache software license version 1\.1"),
    ("apache-1.0", 3, "apache", r"this product includes software developed by the apache group"),
    ("apache", 2, "apache", r"asf licenses this file to you under the apache license"),
    ("llvm-exception", 3, "llvm", r"apache license version 2\.0 with llvm exceptions?"),
    # the GNU family
    ("gpl-3.0-or-later", 3, "later", r"gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-2.0-or-later", 3, "later", r"gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-2.0-only", 3, "gnu", r"gnu general public license version 2 (?:only|as published by the free software foundation)"),
    ("gpl-3.0", 3, "general", r"gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", 3, "general", r"gnu general public license version 2 june 1991"),
    ("gpl-1.0", 3, "general", r"gnu general public license version 1 february 1989"),
    ("gpl-3.0", 2, "gplv3", r"gplv3(?:\+| or later)?"),
    ("gpl-2.0", 2, "gplv2", r"gplv2(?:\+| or later)?"),
    ("gpl-*", 2, "gpl", r"gnu gpl (?:version |v\.?)?[1-3](?:\.0)?"),
    ("gpl", 1, "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl", 1, "received", r"you should have received a copy of the gnu general public license"),
    ("lgpl-2.1-or-later", 3, "lesser", r"gnu lesser general public license as published by the free software foundation either version 2\.1 of the license or (?:at your option )?any later version"),
    ("lgpl-3.0-or-later", 3, "lesser", r"gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("lgpl-2.0", 3, "library", r"gnu library general public license version 2(?:\.0)? june 1991"),
    ("lgpl-2.1", 3, "lesser", r"gnu lesser general public license version 2\.1 february 1999"),
    ("lgpl-3.0", 3, "lesser", r"gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-*", 2, "lgpl", r"(?:gnu )?lgpl ?v?(?:ersion )?[23](?:\.[01])?"),
    ("lgpl", 1, "lesser", r"you should have received a copy of the gnu lesser general public license"),
    ("agpl-3.0", 3, "affero", r"gnu affero general public license version 3 19 november 2007"),
    ("agpl-3.0-or-later", 3, "affero", r"gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("agpl-*", 2, "agpl", r"agpl ?v?(?:ersion )?[13](?:\.0)?"),
    ("gfdl-1.3", 3, "documentation", r"gnu free documentation license version 1\.3"),
    ("gfdl-1.2", 3, "documentation", r"gnu free documentation license version 1\.2"),
    ("gfdl", 2, "documentation", r"under the terms of the gnu free documentation licen[cs]e"),
    ("classpath-exception", 3, "independent", r"linking this library statically or dynamically with other modules is making a combined work based on this library.{0,400}independent modules.{0,120}licen[cs]e"),
    ("classpath-exception", 2, "classpath", r"(?:gpl(?: version)? ?v?2(?:\.0)? )?with (?:the )?classpath exception.{0,60}licen[cs]e"),
    ("gcc-exception-3.1", 3, "gcc", r"gcc runtime library exception version 3\.1.{0,80}licen[cs]e"),
    ("openssl-exception", 3, "openssl", r"permission to link the code of portions of this program with the openssl library"),
    ("bison-exception", 3, "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser.{0,200}licen[cs]e"),
    # weak copyleft
    ("mpl-2.0", 3, "mozilla", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)?\.? 2\.0"),
    ("mpl-2.0", 3, "incompatible", r"this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", 3, "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1.0", 3, "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("mpl", 2, "mozilla", r"subject to the terms of the mozilla public license"),
    ("npl-1.1", 3, "netscape", r"the contents of this file are subject to the netscape public license version 1\.1"),
    ("npl", 2, "netscape", r"netscape public licen[cs]e"),
    ("epl-2.0", 3, "eclipse", r"terms of the eclipse public license (?:v\.? |version )?2(?:\.0)?"),
    ("epl-1.0", 3, "eclipse", r"terms of the eclipse public license (?:v\.? |version )?1(?:\.0)?"),
    ("edl-1.0", 3, "eclipse", r"eclipse distribution license (?:v\.? |version )?1(?:\.0)?"),
    ("cpl-1.0", 3, "common", r"common public license (?:v\.? |version )?1\.0"),
    ("ipl-1.0", 3, "ibm", r"ibm public license version 1\.0"),
    ("cddl-1.0", 3, "development", r"subject to the terms of the common development and distribution license"),
    ("cddl-1.1", 3, "development", r"common development and distribution license (?:cddl )?version 1\.1"),
    ("cddl", 2, "cddl", r"(?:dual )?licensed under (?:the )?cddl"),
    ("apsl-2.0", 3, "apple", r"apple public source license version 2\.0"),
    ("apsl-1.2", 3, "apple", r"apple public source license version 1\.2"),
    ("artistic-2.0", 3, "artistic", r"the artistic license 2\.0"),
    ("artistic-1.0", 2, "perl", r"under the same terms as perl itself.{0,80}licen[cs]e"),
    ("ms-pl", 3, "microsoft", r"microsoft public license ms pl"),
    ("ms-rl", 3, "microsoft", r"microsoft reciprocal license ms rl"),
    ("osl-*", 2, "open", r"licensed under the open software license version [1-3]\.[0-9]"),
    ("afl-*", 2, "academic", r"licensed under the academic free license version [1-3]\.[0-9]"),
    ("afl", 1, "academic", r"academic free licen[cs]e"),
    ("eupl-*", 2, "eupl", r"licensed under the eupl (?:version |v\.? )?1\.[0-2]"),
    ("cecill-*", 2, "cecill", r"governed by the cecill(?: [bc])? license.{0,40}[12](?:\.[01])?"),
    ("cecill", 2, "cecill", r"(?:governed by|subject to) the cecill(?: [bc])? licen[cs]e"),
    ("lppl-1.3c", 3, "latex", r"conditions of the latex project public license either version 1\.3c? of this license"),
    ("lppl", 2, "latex", r"distributed and or modified under the conditions of the latex project public license"),
    ("rpl-1.5", 3, "reciprocal", r"reciprocal public license(?: version)? 1\.5"),
    ("sleepycat", 3, "redistributions", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("sissl", 3, "sun", r"sun industry standards source licen[cs]e"),
    ("zpl-2.1", 3, "zope", r"zope public license zpl version 2\.1"),
    ("zpl-2.0", 3, "zope", r"zope public license zpl version 2\.0"),
    # short permissive texts and dedications
    ("zlib", 3, "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", 3, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 2, "freely", r"to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("libpng", 3, "libpng", r"png reference library license(?: version [0-9]+)?.{0,120}libpng"),
    ("bsl-1.0", 3, "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("bsl-1.0", 2, "boost", r"distributed under the boost software license version 1\.0"),
    ("unlicense", 3, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 2, "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", 3, "waived", r"(?:has|have) waived all copyright and related (?:or|and) neighboring rights"),
    ("cc0-1.0", 3, "cc0", r"cc0 1\.0 universal(?: public domain dedication)?"),
    ("cc0-1.0", 2, "publicdomain", r"creativecommons\.org publicdomain zero 1\.0"),
    ("public-domain", 2, "domain", r"(?:placed|released) in(?:to)? the public domain"),
    ("public-domain", 2, "domain", r"(?:is|are) (?:hereby )?(?:in|dedicated to) the public domain"),
    ("wtfpl-2.0", 3, "fuck", r"do what the fuck you want to public license version 2"),
    ("beerware", 3, "beer", r"you can buy me a beer in return.{0,120}licen[cs]e"),
    ("beerware", 2, "beer", r"the beer ?ware licen[cs]e"),
    ("fsfap", 3, "royalty", r"copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice"),
    ("fsful", 3, "configure", r"this configure script is free software the free software foundation gives unlimited permission"),
    ("python-2.0", 3, "python", r"python software foundation license version 2"),
    ("cnri-python", 3, "cnri", r"cnri open source license agreement"),
    ("php-3.01", 3, "php", r"this source file is subject to version 3\.01 of the php license"),
    ("php-3.0", 3, "php", r"this source file is subject to version 3\.0 of the php license"),
    ("ruby", 3, "ruby", r"ruby is copyrighted free software"),
    ("openssl", 3, "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", 3, "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("w3c", 3, "w3c", r"w3c software (?:and document )?notice and licen[cs]e"),
    ("upl-1.0", 3, "larger", r"and any and all patent rights owned or freely licensable by each licensor.{0,200}larger works"),
    ("ecl-2.0", 3, "educational", r"educational community license version 2\.0"),
    ("mulanpsl-2.0", 3, "mulan", r"licensed under mulan psl v2"),
    ("mulanpsl-1.0", 3, "mulan", r"licensed under (?:the )?mulan psl v1"),
    ("blueoak-1.0.0", 3, "oak", r"blue oak model licen[cs]e"),
    ("imagemagick", 3, "imagemagick", r"imagemagick studio llc.{0,120}licen[cs]e"),
    ("ijg", 3, "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", 3, "freetype", r"portions of this software are copyright .{0,20}the freetype project"),
    ("tcl", 3, "verbatim", r"provided that existing copyright notices are retained in all copies and that this notice is included verbatim"),
    # Creative Commons, data and fonts
    ("cc-by-sa-*", 2, "creative", r"creative commons attribution share ?alike [1-4]\.[0-9]"),
    ("cc-by-nc-sa-*", 2, "creative", r"creative commons attribution non ?commercial share ?alike [1-4]\.[0-9]"),
    ("cc-by-nc-nd-*", 2, "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s [1-4]\.[0-9]"),
    ("cc-by-nc-*", 2, "creative", r"creative commons attribution non ?commercial [1-4]\.[0-9]"),
    ("cc-by-nd-*", 2, "creative", r"creative commons attribution no ?deriv(?:ative)?s [1-4]\.[0-9]"),
    ("cc-by-*", 2, "creative", r"creative commons attribution [1-4]\.[0-9]"),
    ("cc-by-*", 2, "creativecommons", r"creativecommons\.org licenses by [1-4]\.[0-9]"),
    ("cc-by-sa-*", 2, "creativecommons", r"creativecommons\.org licenses by sa [1-4]\.[0-9]"),
    ("cc-by-nc-*", 2, "creativecommons", r"creativecommons\.org licenses by nc [1-4]\.[0-9]"),
    ("cc-by-nd-*", 2, "creativecommons", r"creativecommons\.org licenses by nd [1-4]\.[0-9]"),
    ("cc-by-nc-sa-*", 2, "creativecommons", r"creativecommons\.org licenses by nc sa [1-4]\.[0-9]"),
    ("cc-by-nc-nd-*", 2, "creativecommons", r"creativecommons\.org licenses by nc nd [1-4]\.[0-9]"),
    ("odbl-1.0", 3, "database", r"open database license(?: odbl)? (?:v|version )?1\.0"),
    ("odc-by-1.0", 3, "attribution", r"open data commons attribution licen[cs]e"),
    ("pddl-1.0", 3, "domain", r"open data commons public domain dedication(?: and)? licen[cs]e"),
    ("cdla-permissive-2.0", 3, "permissive", r"community data license agreement permissive(?: version)? 2\.0"),
    ("cdla-sharing-1.0", 3, "sharing", r"community data license agreement sharing(?: version)? 1\.0"),
    ("ofl-1.1", 3, "font", r"this font software is licensed under the sil open font license version 1\.1"),
    ("ofl-1.1", 2, "font", r"sil open font license(?: ofl)? version 1\.1"),
    ("ofl", 2, "font", r"reserved font names?"),
    ("ubuntu-font-1.0", 3, "ubuntu", r"ubuntu font licen[cs]e(?: version)? 1\.0"),
    # source-available and model licenses
    ("sspl-1.0", 3, "server", r"server side public license version 1"),
    ("busl-1.1", 3, "business", r"business source license 1\.1"),
    ("busl", 2, "change", r"change licen[cs]e (?:apache|gpl|mpl|gnu)"),
    ("elastic-2.0", 3, "elastic", r"elastic license(?: version)? 2\.0"),
    ("commons-clause", 3, "commons", r"commons clause licen[cs]e condition"),
    ("polyform", 2, "polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict) licen[cs]e"),
    ("confluent-community", 3, "confluent", r"confluent community licen[cs]e"),
    ("openrail", 2, "rail", r"(?:creativeml |bigscience )?open ?rail(?: m)? licen[cs]e"),
    ("proprietary", 2, "proprietary", r"proprietary and confidential.{0,120}(?:copyright|licen[cs]e|software|permission)"),
    ("proprietary", 2, "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) of this software.{0,80}(?:prohibited|permission)"),
    # notices that name no license
    ("copyright", 0, "copyright", r"copyright c"),
    ("copyright", 0, "reserved", r"all rights reserved"),
)
