"""Signature rules for licenses, in order of priority.

One rule a line: priority, license, keywords, regular expression. A rule runs only on texts that have
one of its keywords (lower case, "|" between them; every match has one as a part). A space in an
expression stands for any white space. Lower numbers win: 1 full grants and notices with a version, 2 names with a version, 3 tags
and links, 4 names without a version, 5 general statements.
"""

TEXT = r"""
1;Apache-2.0;apache license;licensed under the apache license,? version 2(?:\.0)?(?: \(the "license"\))?
1;Apache-2.0;apache license;you may not use this file except in compliance with the (?:apache )?license.{0,80}apache license
1;Apache-2.0;apache license;apache license version 2\.0, january 2004
1;Apache-1.1;apache software license;the apache software license,? version 1\.1
1;Apache-1.0;apache group;redistributions of any form whatsoever must retain .{0,80}apache group
1;MIT;permission is hereby granted;permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
1;MIT-0;permission is hereby granted;permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files .{0,300}sell copies of the software, and to permit persons to whom the software is furnished to do so\.
1;MIT;as is;the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
1;MIT;mit license;(?:licensed|released|distributed|available) under the (?:terms of the )?mit license
1;X11;x consortium;except as contained in this notice, the name of the x consortium shall not be used in advertising
1;ISC;permission to use, copy, modify;permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted, provided
1;0BSD;permission to use, copy, modify;permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted\.
1;HPND;permission to use, copy, modify;permission to use, copy, modify,? and distribute this software and its documentation for any purpose
1;BSD-2-Clause;redistribution and use;redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
1;BSD-3-Clause;endorse or promote;neither the name of .{1,120} nor the names of its contributors may be used to endorse or promote products derived from this software
1;BSD-4-Clause;advertising materials;all advertising materials mentioning features or use of this software must display the following acknowledge?ment
1;BSD-3-Clause;bsd;(?:licensed|released|distributed|available) under (?:the|a) (?:3-clause|three-clause|new|modified|revised) bsd license
1;BSD-2-Clause;bsd;(?:licensed|released|distributed|available) under (?:the|a) (?:2-clause|two-clause|simplified|freebsd) bsd license
1;BSD-style;bsd;(?:use of this source code is )?governed by a bsd-style license
1;GPL-3.0-or-later;general public license;redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation,? either version 3 of the license,? or \(at your option\) any later version
1;GPL-2.0-or-later;general public license;redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation[;,]? either version 2 of the license,? or \(at your option\) any later version
1;GPL-1.0-or-later;general public license;redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation[;,]? either version 1,? or \(at your option\) any later version
1;GPL-3.0-only;general public license;licensed under the (?:terms of the )?gnu general public license,? (?:version|v\.?) ?3(?:\.0)?
1;GPL-2.0-only;general public license;licensed under the (?:terms of the )?gnu general public license,? (?:version|v\.?) ?2(?:\.0)?
1;GPL-2.0-only;general public license;under the terms of the gnu general public license,? version 2(?:\.0)?,? as published by the free software foundation
1;GPL-2.0-only;general public license;under the terms of version 2 of the gnu general public license
1;GPL-3.0-only;general public license;under the terms of version 3 of the gnu general public license
1;GPL-3.0;general public license;gnu general public license version 3, 29 june 2007
1;GPL-2.0;general public license;gnu general public license version 2, june 1991
1;GPL-1.0;general public license;gnu general public license version 1, february 1989
1;LGPL-3.0-or-later;lesser general public license;under the terms of the gnu lesser general public license .{0,60}either version 3(?:\.0)? of the license,? or \(at your option\) any later version
1;LGPL-2.1-or-later;lesser general public license;under the terms of the gnu lesser general public license .{0,60}either version 2\.1 of the license,? or \(at your option\) any later version
1;LGPL-2.0-or-later;library general public license;under the terms of the gnu library general public license .{0,60}either version 2 of the license,? or \(at your option\) any later version
1;LGPL-3.0-only;lesser general public license;licensed under the (?:terms of the )?gnu lesser general public license,? (?:version|v\.?) ?3(?:\.0)?
1;LGPL-2.1-only;lesser general public license;licensed under the (?:terms of the )?gnu lesser general public license,? (?:version|v\.?) ?2\.1
1;AGPL-3.0-or-later;affero general public license;under the terms of the gnu affero general public license .{0,60}either version 3 of the license,? or \(at your option\) any later version
1;AGPL-3.0-only;affero general public license;licensed under the (?:terms of the )?gnu affero general public license,? (?:version|v\.?) ?3(?:\.0)?
1;AGPL-1.0;affero general public license;affero general public license version 1, march 2002
1;GFDL-1.3-or-later;free documentation license;under the terms of the gnu free documentation license,? version 1\.3 or any later version
1;GFDL-1.2-or-later;free documentation license;under the terms of the gnu free documentation license,? version 1\.2 or any later version
1;GFDL-1.1-or-later;free documentation license;under the terms of the gnu free documentation license,? version 1\.1 or any later version
1;MPL-2.0;mozilla public;this source code form is subject to the terms of the mozilla public license,? v(?:ersion|\.) ?2\.0
1;MPL-2.0;mozilla public;licensed under the mozilla public license,? (?:version|v\.?) ?2(?:\.0)?
1;MPL-1.1;mozilla public;the contents of this file are subject to the mozilla public license version 1\.1
1;MPL-1.0;mozilla public;the contents of this file are subject to the mozilla public license version 1\.0
1;NPL-1.1;netscape public;the contents of this file are subject to the netscape public license version 1\.1
1;EPL-2.0;eclipse public;made available under the terms of the eclipse public license,? (?:version|v\.?) ?2(?:\.0)?
1;EPL-1.0;eclipse public;made available under the terms of the eclipse public license,? (?:version|v\.?) ?1(?:\.0)?
1;CDDL-1.1;common development and distribution;the contents of this file are subject to the terms of .{0,60}common development and distribution license.{0,10}version 1\.1
1;CDDL-1.0;common development and distribution;the contents of this file are subject to the terms of the common development and distribution license
1;CPL-1.0;common public license;made available under the terms of the common public license
1;EUPL-1.2;european union public|eupl;licensed under the (?:eupl|european union public licen[cs]e),? (?:version|v\.?) ?1\.2
1;EUPL-1.1;european union public|eupl;licensed under the (?:eupl|european union public licen[cs]e),? (?:version|v\.?) ?1\.1
1;EUPL-1.2;eupl;licensed under the eupl,? (?:version |v\.?)?1\.2
1;BSL-1.0;boost software;distributed under the boost software license,? version 1\.0
1;BSL-1.0;boost software;boost software license - version 1\.0 - august 17th, 2003
1;Zlib;origin of this software;the origin of this software must not be misrepresented; you must not claim that you wrote the original software
1;Unlicense;public domain;this is free and unencumbered software released into the public domain
1;WTFPL;do what the fuck;do what the fuck you want to public license
1;CC0-1.0;cc0;to the extent possible under law, .{1,120} has waived all copyright .{0,80}cc0
1;CC0-1.0;cc0;(?:licensed|released|dedicated|available) (?:under|to) (?:the )?(?:creative commons )?cc0(?: 1\.0(?: universal)?)?
1;CC-BY-NC-ND-4.0;by-nc-nd;(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons )?cc[ -]by-nc-nd[ -]4\.0
1;CC-BY-NC-SA-4.0;by-nc-sa;(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons )?cc[ -]by-nc-sa[ -]4\.0
1;CC-BY-NC-4.0;by-nc;(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons )?cc[ -]by-nc[ -]4\.0
1;CC-BY-ND-4.0;by-nd;(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons )?cc[ -]by-nd[ -]4\.0
1;CC-BY-SA-4.0;by-sa;(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons )?cc[ -]by-sa[ -]4\.0
1;CC-BY-4.0;cc;(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons )?cc[ -]by[ -]4\.0
1;CC-BY-NC-ND-3.0;by-nc-nd;(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons )?cc[ -]by-nc-nd[ -]3\.0
1;CC-BY-NC-SA-3.0;by-nc-sa;(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons )?cc[ -]by-nc-sa[ -]3\.0
1;CC-BY-NC-3.0;by-nc;(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons )?cc[ -]by-nc[ -]3\.0
1;CC-BY-ND-3.0;by-nd;(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons )?cc[ -]by-nd[ -]3\.0
1;CC-BY-SA-3.0;by-sa;(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons )?cc[ -]by-sa[ -]3\.0
1;CC-BY-3.0;cc;(?:licensed|released|distributed|available) under (?:a |the )?(?:creative commons )?cc[ -]by[ -]3\.0
1;CC-BY-4.0;creative commons attribution;creative commons attribution 4\.0(?: international)?(?: \(cc by 4\.0\))?(?: public)? licen[cs]e
1;CC-BY-SA-4.0;creative commons attribution;creative commons attribution[- ]share[- ]?alike 4\.0(?: international)?(?: \(cc by-sa 4\.0\))?(?: public)? licen[cs]e
1;CC-BY-NC-4.0;creative commons attribution;creative commons attribution[- ]non-?commercial 4\.0(?: international)?(?: \(cc by-nc 4\.0\))?(?: public)? licen[cs]e
1;CC-BY-ND-4.0;creative commons attribution;creative commons attribution[- ]no-?deriv(?:ative)?s 4\.0(?: international)?(?: public)? licen[cs]e
1;CC-BY-NC-SA-4.0;creative commons attribution;creative commons attribution[- ]non-?commercial[- ]share-?alike 4\.0(?: international)?(?: public)? licen[cs]e
1;CC-BY-NC-ND-4.0;creative commons attribution;creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s 4\.0(?: international)?(?: public)? licen[cs]e
1;CC-BY-3.0;creative commons attribution;creative commons attribution 3\.0(?: unported)? licen[cs]e
1;CC-BY-SA-3.0;creative commons attribution;creative commons attribution[- ]share[- ]?alike 3\.0(?: unported)? licen[cs]e
1;CC-BY-NC-3.0;creative commons attribution;creative commons attribution[- ]non-?commercial 3\.0(?: unported)? licen[cs]e
1;CC-BY-NC-SA-3.0;creative commons attribution;creative commons attribution[- ]non-?commercial[- ]share-?alike 3\.0(?: unported)? licen[cs]e
1;CC-BY-NC-ND-3.0;creative commons attribution;creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s 3\.0(?: unported)? licen[cs]e
1;CC-BY-2.5;creative commons attribution;creative commons attribution 2\.5 licen[cs]e
1;CC-BY-SA-2.5;creative commons attribution;creative commons attribution[- ]share-?alike 2\.5 licen[cs]e
1;CC-BY-2.0;creative commons attribution;creative commons attribution 2\.0 licen[cs]e
1;CC-BY-SA-2.0;creative commons attribution;creative commons attribution[- ]share-?alike 2\.0 licen[cs]e
1;OFL-1.1;open font license;licensed under the sil open font license,? version 1\.1
1;OFL-1.0;open font license;licensed under the sil open font license,? version 1\.0
1;ODbL-1.0;open database license;made available under the open database license
1;ODC-By-1.0;attribution license;made available under the open data commons attribution license
1;PDDL-1.0;public domain dedication;made available under the public domain dedication and license
1;OGL-UK-3.0;open government licence;licensed under the open government licence v(?:ersion )?3(?:\.0)?
1;OGL-UK-2.0;open government licence;licensed under the open government licence v(?:ersion )?2(?:\.0)?
1;Artistic-2.0;artistic license;(?:licensed )?under the (?:terms of the )?artistic license,? (?:version )?2\.0
1;Artistic-1.0-or-GPL;same terms as perl;(?:redistribute|modify) it under the same terms as perl itself
1;Python-2.0;python software foundation;python software foundation license version 2
1;PSF-2.0;psf license;psf license agreement for python
1;Ruby;ruby;you can redistribute it and/or modify it under the same terms as ruby
1;PHP-3.01;php license;this source file is subject to version 3\.01 of the php license
1;PHP-3.0;php license;this source file is subject to version 3\.0 of the php license
1;PostgreSQL;postgresql;postgresql database management system .{0,300}permission to use, copy, modify
1;OpenSSL;openssl;this product includes software developed by the openssl project
1;SSPL-1.0;server side public license;server side public license,? version 1
1;BUSL-1.1;business source license;business source license 1\.1
1;Elastic-2.0;elastic license;licensed under the elastic license(?:,? version)? 2\.0
1;AFL-3.0;academic free license;licensed under the academic free license version 3\.0
1;OSL-3.0;open software license;licensed under the open software license version 3\.0
1;MS-PL;microsoft public license;licensed under the microsoft public license
1;MS-RL;microsoft reciprocal;licensed under the microsoft reciprocal license
1;UPL-1.0;universal permissive;licensed under the universal permissive license v(?:ersion |\.? ?)1\.0
1;NCSA;illinois;university of illinois/ncsa open source license
1;W3C;w3c;this work is (?:being )?provided .{0,80}under the w3c software
1;Beerware;beer;you think this stuff is worth it, you can buy me a beer
1;JSON;good, not evil;the software shall be used for good, not evil
1;Vim;vim license;distributed under the vim license
1;CECILL-2.1;cecill;governed by the cecill license .{0,120}version 2\.1
1;CECILL-B;cecill-b;governed by the cecill-b license
1;CECILL-C;cecill-c;governed by the cecill-c license
1;LPPL-1.3c;latex project public;under the conditions of the latex project public license,? .{0,30}version 1\.3
1;OpenRAIL-M;openrail;(?:licensed|released|available) under the .{0,40}openrail(?:\+\+)?-m licen[cs]e
2;Apache-2.0;apache;apache(?: software)? licen[cs]e,? (?:version |v\.?)?2(?:\.0)?
2;Apache-2.0;apache-2;\bapache-2\.0\b
2;Apache-1.1;apache;apache(?: software)? licen[cs]e,? (?:version |v\.?)?1\.1
2;GPL-3.0-only;general public;gnu general public licen[cs]e,? \(?(?:version|v\.?) ?3(?:\.0)?
2;GPL-2.0-only;general public;gnu general public licen[cs]e,? \(?(?:version|v\.?) ?2(?:\.0)?
2;GPL-1.0-only;general public;gnu general public licen[cs]e,? \(?(?:version|v\.?) ?1(?:\.0)?
2;GPL-3.0-only;gpl;\b(?:gnu )?gpl,? ?-?(?:version |v\.?) ?3(?:\.0)?\b
2;GPL-2.0-only;gpl;\b(?:gnu )?gpl,? ?-?(?:version |v\.?) ?2(?:\.0)?\b
2;GPL-3.0-or-later;gplv3;\bgplv3(?:\+| or later)
2;GPL-2.0-or-later;gplv2;\bgplv2(?:\+| or later)
2;LGPL-3.0-only;lesser general;gnu lesser general public licen[cs]e,? \(?(?:version|v\.?) ?3(?:\.0)?
2;LGPL-2.1-only;lesser general;gnu lesser general public licen[cs]e,? \(?(?:version|v\.?) ?2\.1
2;LGPL-2.0-only;library general;gnu library general public licen[cs]e,? \(?(?:version|v\.?) ?2(?:\.0)?
2;LGPL-3.0-only;lgpl;\blgpl,? ?-?(?:version |v\.?) ?3(?:\.0)?\b
2;LGPL-2.1-only;lgpl;\blgpl,? ?-?(?:version |v\.?) ?2\.1\b
2;AGPL-3.0-only;affero;gnu affero general public licen[cs]e,? \(?(?:version|v\.?) ?3(?:\.0)?
2;AGPL-3.0-only;agpl;\bagpl,? ?-?(?:version |v\.?) ?3(?:\.0)?\b
2;GFDL-1.3;free documentation;gnu free documentation licen[cs]e,? \(?(?:version|v\.?) ?1\.3
2;GFDL-1.2;free documentation;gnu free documentation licen[cs]e,? \(?(?:version|v\.?) ?1\.2
2;GFDL-1.1;free documentation;gnu free documentation licen[cs]e,? \(?(?:version|v\.?) ?1\.1
2;MPL-2.0;mozilla;mozilla public licen[cs]e,? \(?(?:version |v\.?)? ?2(?:\.0)?
2;MPL-1.1;mozilla;mozilla public licen[cs]e,? \(?(?:version |v\.?)? ?1\.1
2;MPL-2.0;mpl;\bmpl[- ]2\.0\b
2;EPL-2.0;eclipse;eclipse public licen[cs]e,? (?:- )?\(?(?:version |v\.?)? ?2(?:\.0)?
2;EPL-1.0;eclipse;eclipse public licen[cs]e,? (?:- )?\(?(?:version |v\.?)? ?1(?:\.0)?
2;EDL-1.0;eclipse;eclipse distribution licen[cs]e,? (?:- )?(?:version |v\.?)? ?1(?:\.0)?
2;CDDL-1.1;cddl;\bcddl[- ](?:version |v)?1\.1\b
2;CDDL-1.0;cddl;\bcddl[- ](?:version |v)?1\.0\b
2;EUPL-1.2;eupl;\beupl[- ](?:version |v)?1\.2\b
2;EUPL-1.1;eupl;\beupl[- ](?:version |v)?1\.1\b
2;BSL-1.0;boost;boost software licen[cs]e,? (?:version |v\.?)?1\.0
2;BSD-3-Clause;bsd;\bbsd[- ](?:3|three)[- ]clause\b
2;BSD-3-Clause;clause bsd;\b(?:3|three)[- ]clause bsd\b
2;BSD-2-Clause;bsd;\bbsd[- ](?:2|two)[- ]clause\b
2;BSD-2-Clause;clause bsd;\b(?:2|two)[- ]clause bsd\b
2;BSD-4-Clause;bsd;\bbsd[- ](?:4|four)[- ]clause\b
2;BSD-3-Clause;new bsd;\bnew bsd licen[cs]e
2;BSD-3-Clause;modified bsd;\bmodified bsd licen[cs]e
2;BSD-2-Clause;simplified bsd;\bsimplified bsd licen[cs]e
2;CC0-1.0;cc0;\bcc0[- ]1\.0(?: universal)?\b
2;CC-BY-4.0;cc;\bcc[- ]by[- ](?:4\.0|v4)\b
2;CC-BY-3.0;cc;\bcc[- ]by[- ](?:3\.0|v3)\b
2;CC-BY-2.5;cc;\bcc[- ]by[- ]2\.5\b
2;CC-BY-2.0;cc;\bcc[- ]by[- ]2\.0\b
2;CC-BY-SA-4.0;by-sa;\bcc[- ]by-sa[- ](?:4\.0|v4)\b
2;CC-BY-SA-3.0;by-sa;\bcc[- ]by-sa[- ](?:3\.0|v3)\b
2;CC-BY-SA-2.5;by-sa;\bcc[- ]by-sa[- ]2\.5\b
2;CC-BY-SA-2.0;by-sa;\bcc[- ]by-sa[- ]2\.0\b
2;CC-BY-ND-4.0;by-nd;\bcc[- ]by-nd[- ](?:4\.0|v4)\b
2;CC-BY-ND-3.0;by-nd;\bcc[- ]by-nd[- ](?:3\.0|v3)\b
2;CC-BY-NC-4.0;by-nc;\bcc[- ]by-nc[- ](?:4\.0|v4)\b
2;CC-BY-NC-3.0;by-nc;\bcc[- ]by-nc[- ](?:3\.0|v3)\b
2;CC-BY-NC-2.0;by-nc;\bcc[- ]by-nc[- ]2\.[05]\b
2;CC-BY-NC-SA-4.0;by-nc-sa;\bcc[- ]by-nc-sa[- ](?:4\.0|v4)\b
2;CC-BY-NC-SA-3.0;by-nc-sa;\bcc[- ]by-nc-sa[- ](?:3\.0|v3)\b
2;CC-BY-NC-ND-4.0;by-nc-nd;\bcc[- ]by-nc-nd[- ](?:4\.0|v4)\b
2;CC-BY-NC-ND-3.0;by-nc-nd;\bcc[- ]by-nc-nd[- ](?:3\.0|v3)\b
2;OFL-1.1;font;(?:sil )?open font licen[cs]e,? (?:version |v)?1\.1
2;ODbL-1.0;odbl;\bodbl[- ](?:v)?1\.0\b
2;ODC-By-1.0;odc-by;\bodc-by[- ](?:v)?1\.0\b
2;Artistic-2.0;artistic;artistic licen[cs]e,? (?:version )?2\.0
2;Artistic-1.0;artistic;artistic licen[cs]e,? (?:version )?1\.0
2;OGL-UK-3.0;government;open government licen[cs]e,? v(?:ersion )?3(?:\.0)?
2;AFL-3.0;academic;academic free licen[cs]e,? (?:version |v\.?)?3\.0
2;AFL-2.1;academic;academic free licen[cs]e,? (?:version |v\.?)?2\.1
2;OSL-3.0;open software;open software licen[cs]e,? (?:version |v\.?)?3\.0
2;ZPL-2.1;zope;zope public licen[cs]e,? (?:\(zpl\) )?(?:version |v\.?)?2\.1
2;ZPL-2.0;zope;zope public licen[cs]e,? (?:\(zpl\) )?(?:version |v\.?)?2\.0
2;QPL-1.0;q public;q public licen[cs]e,? (?:version )?1\.0
2;IPL-1.0;ibm public;ibm public licen[cs]e,? (?:version )?1\.0
2;SPL-1.0;sun public;sun public licen[cs]e,? (?:version )?1\.0
2;APSL-2.0;apple public;apple public source licen[cs]e,? (?:version )?2\.0
2;MulanPSL-2.0;mulan;mulan (?:psl|permissive software licen[cs]e),? ?v(?:ersion )?2
2;CERN-OHL-S-2.0;cern;cern open hardware licen[cs]e version 2 - strongly reciprocal
2;CERN-OHL-W-2.0;cern;cern open hardware licen[cs]e version 2 - weakly reciprocal
2;CERN-OHL-P-2.0;cern;cern open hardware licen[cs]e version 2 - permissive
2;Llama-2;llama 2;llama 2 community licen[cs]e(?: agreement)?
2;Llama-3;llama 3;llama 3(?:\.[123])? community licen[cs]e(?: agreement)?
2;SGI-B-2.0;sgi free;sgi free software licen[cs]e b,? version 2\.0
2;Polyform-NC-1.0.0;polyform;polyform noncommercial licen[cs]e 1\.0\.0
2;Blue-Oak-1.0.0;blue oak;blue oak model licen[cs]e(?: 1\.0\.0)?
3;SPDX;spdx-license-identifier;spdx-license-identifier: ?\(?[a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*\)?
3;Apache-2.0;apache.org/licenses;https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
3;GPL-3.0;gnu.org/licenses;https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0[a-z.]*
3;GPL-2.0;gnu.org/licenses;https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0[a-z.]*
3;LGPL-3.0;gnu.org/licenses;https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0[a-z.]*
3;LGPL-2.1;gnu.org/licenses;https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1[a-z.]*
3;AGPL-3.0;gnu.org/licenses;https?://(?:www\.)?gnu\.org/licenses/agpl-3\.0[a-z.]*
3;GFDL-1.3;gnu.org/licenses;https?://(?:www\.)?gnu\.org/licenses/fdl-1\.3[a-z.]*
3;GPL;gnu.org/licenses;https?://(?:www\.)?gnu\.org/licenses/gpl\.(?:html|txt)
3;MPL-2.0;mozilla.org/mpl;https?://(?:www\.)?mozilla\.org/mpl/2\.0/?
3;MPL-1.1;mozilla.org/mpl;https?://(?:www\.)?mozilla\.org/mpl/mpl-1\.1[a-z.]*
3;MIT;opensource.org/licenses;https?://(?:www\.)?opensource\.org/licenses/mit(?:-license)?(?:\.php|\.html)?
3;BSD;opensource.org/licenses;https?://(?:www\.)?opensource\.org/licenses/bsd-[23]-clause
3;ISC;opensource.org/licenses;https?://(?:www\.)?opensource\.org/licenses/isc
3;EPL;eclipse.org/legal;https?://(?:www\.)?eclipse\.org/legal/epl-(?:v10|2\.0)[a-z./]*
3;BSL-1.0;boost.org/license;https?://(?:www\.)?boost\.org/license_1_0\.txt
3;Unlicense;unlicense.org;https?://(?:www\.)?unlicense\.org/?
3;CC-BY-NC-ND;creativecommons.org;https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/[0-9.]+/?
3;CC-BY-NC-SA;creativecommons.org;https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/[0-9.]+/?
3;CC-BY-NC;creativecommons.org;https?://(?:www\.)?creativecommons\.org/licenses/by-nc/[0-9.]+/?
3;CC-BY-ND;creativecommons.org;https?://(?:www\.)?creativecommons\.org/licenses/by-nd/[0-9.]+/?
3;CC-BY-SA;creativecommons.org;https?://(?:www\.)?creativecommons\.org/licenses/by-sa/[0-9.]+/?
3;CC-BY;creativecommons.org;https?://(?:www\.)?creativecommons\.org/licenses/by/[0-9.]+/?
3;CC0-1.0;creativecommons.org;https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0/?
3;CC-PDM-1.0;creativecommons.org;https?://(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0/?
3;OFL-1.1;scripts.sil.org;https?://scripts\.sil\.org/ofl
3;ODbL-1.0;opendatacommons.org;https?://(?:www\.)?opendatacommons\.org/licenses/odbl/?(?:1\.0|1-0)?/?
3;ODC-By-1.0;opendatacommons.org;https?://(?:www\.)?opendatacommons\.org/licenses/by/?(?:1\.0|1-0)?/?
4;Apache;apache;\bapache licen[cs]e\b
4;MIT;mit licen|mit-licen;\bmit[- ]licen[cs]ed?\b
4;MIT;expat;\bexpat licen[cs]e\b
4;ISC;isc licen;\bisc licen[cs]e\b
4;BSD;bsd;\bbsd[- ](?:style )?licen[cs]ed?\b
4;GPL;general public;\bgnu general public licen[cs]e\b
4;LGPL;lesser general;\bgnu lesser general public licen[cs]e\b
4;LGPL;library general;\bgnu library general public licen[cs]e\b
4;AGPL;affero;\b(?:gnu )?affero general public licen[cs]e\b
4;GFDL;free documentation;\bgnu free documentation licen[cs]e\b
4;GPL;gpl;\b(?:gnu )?gpl(?:[- ]licen[cs]ed?)?\b
4;LGPL;lgpl;\blgpl\b
4;AGPL;agpl;\bagpl\b
4;MPL;mozilla;\bmozilla public licen[cs]e\b
4;EPL;eclipse;\beclipse public licen[cs]e\b
4;CDDL;common development;\bcommon development and distribution licen[cs]e\b
4;Artistic;artistic;\bartistic licen[cs]e\b
4;Zlib;zlib;\bzlib(?:/libpng)? licen[cs]e\b
4;BSL-1.0;boost;\bboost software licen[cs]e\b
4;OFL;font;\b(?:sil )?open font licen[cs]e\b
4;Unlicense;unlicense;\bthe unlicense\b
4;WTFPL;wtfpl;\bwtfpl\b
4;PSF;python software;\bpython software foundation licen[cs]e\b
4;CC-BY-NC-ND;by-nc-nd;\bcc[- ]by-nc-nd\b
4;CC-BY-NC-SA;by-nc-sa;\bcc[- ]by-nc-sa\b
4;CC-BY-NC;by-nc;\bcc[- ]by-nc\b
4;CC-BY-ND;by-nd;\bcc[- ]by-nd\b
4;CC-BY-SA;by-sa;\bcc[- ]by-sa\b
4;CC-BY;cc;\bcc[- ]by\b
4;CC0;cc0;\bcc0\b
4;CC-BY-NC-SA;creative commons attribution;creative commons attribution[- ]non-?commercial[- ]share[- ]?alike
4;CC-BY-NC-ND;creative commons attribution;creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s
4;CC-BY-NC;creative commons attribution;creative commons attribution[- ]non-?commercial
4;CC-BY-SA;creative commons attribution;creative commons attribution[- ]share[- ]?alike
4;CC-BY-ND;creative commons attribution;creative commons attribution[- ]no-?deriv(?:ative)?s
4;CC-BY;creative commons attribution;creative commons attribution
4;CC;creative commons;creative commons(?: licen[cs]e)?
4;ODbL;open database;\bopen database licen[cs]e\b
4;SSPL;server side;\bserver side public licen[cs]e\b
4;BUSL;business source;\bbusiness source licen[cs]e\b
4;OpenRAIL;openrail;\b(?:creativeml |bigscience |bigcode )?openrail(?:\+\+)?(?:-m|-d|-s)?\b
5;public-domain;public domain;(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain
5;all-rights-reserved;all rights reserved;all rights reserved
5;copyright;copyright;copyright (?:\(c\)|©)? ?(?:19|20)[0-9]{2}(?: ?[-,–] ?(?:19|20)[0-9]{2})*(?: by)?
5;copyright;©;© ?(?:copyright )?(?:19|20)[0-9]{2}(?: ?[-,–] ?(?:19|20)[0-9]{2})*
5;proprietary;proprietary and confidential;(?:this (?:document|file|software) (?:is|contains) )?proprietary and confidential
5;proprietary;unauthorized copying;unauthorized copying (?:of this file|or distribution),? (?:via any medium )?(?:is )?strictly prohibited
5;proprietary;may not be reproduced;may not be reproduced (?:or (?:transmitted|distributed) )?(?:in any form )?without .{0,40}permission
5;proprietary;trade secret;contains? (?:confidential information and )?trade secrets?
5;non-commercial;non-commercial;for (?:personal,? )?(?:and )?non-commercial use only
5;non-commercial;research purposes only;for (?:academic )?research purposes only
5;educational;educational use only;for educational use only
5;permission;with permission|with the permission;(?:reprinted|reproduced|used) with (?:the )?permission (?:of|from|by)
5;dual-license;dual;\bdual[- ]licen[cs]ed under\b
5;open-source;open source licen;\b(?:an? )?(?:osi[- ]approved )?open source licen[cs]e
"""
