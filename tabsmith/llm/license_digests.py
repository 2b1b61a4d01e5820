"""SHA-256 of the canonical forms of full licence texts; written by scripts/license_digests.py."""

FULL_TEXTS = {
    "41d328385277b2ac2c310f16b156af3740407801519f29de18171772f82acb42": "Apache-2.0",
    "534db50201d019e6d607b9eb788fbe78ba9e2d698418c2733cc7256ff36b14f9": "Apache-2.0",
    "5d27112d98f6dbe8ba9ca284aeed0f4cc8bb3c51c0f2d8225a621c0d33c7abcb": "Apache-2.0",
    "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38": "Apache-2.0",
    "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6": "Apache-2.0",
    "7b0bb1d8dbcbea1c802d3a288b3fd4d1c82b219c4c4282bea036884ebf036aea": "Apache-2.0",
    "b006954ca49c595831e44592054eb7df00763beda6df38e52e9d36a02a916ef5": "Apache-2.0",
    "b7901703ca7de49fb934ca388db46676217c8b5502d35203ff525c15b226b8e1": "Apache-2.0",
    "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff": "Apache-2.0",
    "09298ea5f55a44867296b42e98842579815a99e2b295c0aa24cf234134c9ebeb": "Artistic-1.0-Perl",
    "a4ded8988ccbb4ad5cd1c456fb05c8c715750b157280d90781e42881f018301b": "Artistic-1.0-Perl",
    "dce473218f071e33d95a6d9fd8eef04043176d3f4b0c2f3d22b96d545467bea7": "Artistic-1.0-Perl",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "13a06619caac563ef75dbb6b16c7b185cd8a7255a4c7134aecf15ed03eeb0b9e": "CC0-1.0",
    "bb878d68e2bd11ce5ffb0510fa88413b5dfd6d8fe1de780da66de6f74cf984af": "CC0-1.0",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "e91800afc6c48672fba71b29313951a2d91bd4f1e1d61ee386402d621dba7a0a": "CC0-1.0",
    "2f1a0498221587b397469344ab897095ce242b0776f85e00678df78fd17b0053": "GFDL-1.2-only",
    "31d1e54824dc6954a36d4d6510f749ab693be943260bc59079362a26ad74ea17": "GFDL-1.2-only",
    "46df66eb30fadb738a42b19ccce2f18a583866e5837bccc790b4acff41ba12da": "GFDL-1.2-only",
    "774142f7f9d180b719ac1fe23dfba3589d91276d948e4dd116cb8811cec60691": "GFDL-1.2-only",
    "7b53826fb8825aa3994e10565ccb6d98a62ace1cc7827318c8b10672c0293275": "GFDL-1.2-only",
    "84f3c9e8cdded0036378e7e6eb92ac6570731434d2fc46027f259264dc16501e": "GFDL-1.2-only",
    "893cfaa4ed374ccd5be70e589f7549e7225d4fab41f4ed2469dd04662ec3b7db": "GFDL-1.2-only",
    "911acdf1929af65f8940939eae8eeabb39352742b2ed41f84bf883f4bace3555": "GFDL-1.2-only",
    "915561db8eb69b9193eeb710593d298365e0c52787feb731c684977d5b417af7": "GFDL-1.2-only",
    "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60": "GFDL-1.2-only",
    "a09a9415e4fdd9da7f2f8c67a4409e9db4021bdd1d76901f451932de9350766e": "GFDL-1.2-only",
    "a2c7d741d859fa142345a0453e6ad469b3dff00999c5d1e64ee7cdd51ff7df7d": "GFDL-1.2-only",
    "b87baa2747d68fbc956cef4f4be9e25f0f91d23a6f7c7fd47294c27147c26711": "GFDL-1.2-only",
    "bb893add3d24a414e0a92d05a8bb9175e4bf95c571ef7d75e90c171148d977f5": "GFDL-1.2-only",
    "cf77a218f7e648ebe9d44aff699b1056c915fd1eea45e7b689929ae0f252531d": "GFDL-1.2-only",
    "d445ab3336df310a32296d121e8ac7517fb258a8fb065fed8e1dbba0347b2973": "GFDL-1.2-only",
    "ff91799d3ddbe957e59799e0f6965cbe788e2145ddbc1a3f543abdeae3d67187": "GFDL-1.2-only",
    "ffeb18a1c7bfe6e0868297754b4d7da1fd282166ed5d1b796f7efb4473972e28": "GFDL-1.2-only",
    "092c28e0aeabbd2368456ee054468ce1c70d2183db70a5d19cf784ea703835ba": "GFDL-1.3-only",
    "0a544e14663c3f86687b0b1221daa784d4c9aea091a0f18111963b4985be5fa0": "GFDL-1.3-only",
    "3c426fbfcdf22792d87bb85fe1538455be3c49904a6d4c0f754f86b16154c8bf": "GFDL-1.3-only",
    "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826": "GFDL-1.3-only",
    "b05b2bea1732c0cf884ed9806e715194592c433821b770f37f8ec58b6f5f14ea": "GFDL-1.3-only",
    "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90": "GFDL-1.3-only",
    "1b19b24f361646cf4f197155866d72e9f0d5011031bb1351fcf10e24aa2f7b35": "GPL-1.0-only",
    "2ec1bd728dd10424f13890e12c27cca8a713a003952eee473fece8ff22798462": "GPL-1.0-only",
    "3b2524d27cb227016df68d1515394e8993b4bbf50c77d600de91a4399cb28f90": "GPL-1.0-only",
    "41020c05cfcb8b166bdf0c64e7f5f539feb5e7694933cf7d3bb79f6accd702b2": "GPL-1.0-only",
    "422dc6ece1afadb367f2bcdbf6ac496f4c7ad5c973c45cdd09ae377ceb4c8a12": "GPL-1.0-only",
    "4449b2a0b2da0e1097057c5b80004cb7dbf2c43a1cf47e127c2d92a274e4f944": "GPL-1.0-only",
    "4a0d740eb4453dafe0e6d04e2d2e4f04c7c85bc1fbef96bc056ea93e7c1c36bc": "GPL-1.0-only",
    "526a998a5f0ae9ed2e8c2dc03c12942fc9d724df13b0787dd3c80881d3688444": "GPL-1.0-only",
    "542eb44393b47446e7b5d9abb98b24262db09390d5986f0fb6feef9ead833086": "GPL-1.0-only",
    "578a2456c3164da6521078c9cc820b0f9e9f335334047850bbf8d5afd3d5e472": "GPL-1.0-only",
    "5eba6902f4038a84a80879771855363939c7b81b83d57e7a776812d6d04c1b9b": "GPL-1.0-only",
    "5fcc149debc187a5439faada41342d88a9040d1fed00ca78f543889aa201bb79": "GPL-1.0-only",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0-only",
    "6b8aa061ab2468f72680f44d91b7b093a92b1f5b12af8a9ff0e0efa0f1ad9d32": "GPL-1.0-only",
    "6ca08526ee81355436001f14a8806abe1b624bd69c193bcb74e2abc8e629ade5": "GPL-1.0-only",
    "71fa4bd5fde166ce4fa896f8698e1bcf77024e8a262598b2ea4d3bcad7b6812f": "GPL-1.0-only",
    "733356cadf8ca8b0ac2db2d593fb7c1a2b0528c7e891f8a911fdaeb64719fff5": "GPL-1.0-only",
    "757ffb088f9f72935901695e43cf367636fc5a38bf315f11f0ea64e46f5d1ef9": "GPL-1.0-only",
    "7b86297a2762700b078231c8b488809b0f63cac5e298d74f4270d251bbef230f": "GPL-1.0-only",
    "7c09aae3c270285817b370de14a701a9ba0c7d9b56b1c3a7be3b96e6ba5ed01f": "GPL-1.0-only",
    "858bb219a7a780439b4bc4b70a09728cb4a536c4609a75c282fdaf69c8a85201": "GPL-1.0-only",
    "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70": "GPL-1.0-only",
    "8f3791039a137dc41a4222725079093e91fe98d5b92a8a4c0619e88addd253c6": "GPL-1.0-only",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0-only",
    "94e760d7825b0ffd5e4a7b6ed5aff36b1a4487a767d964c5e35b5da8bf5f1083": "GPL-1.0-only",
    "98c96304603be152968c123e484f744c9b51ebd341914aee6eea5c39133891e1": "GPL-1.0-only",
    "9b80eb3145b87968fde482b384ff47a39c81a9f3f04b7b569a2876c47d7ebdf8": "GPL-1.0-only",
    "a8a98615692e6d9738a3b77686ce468850d1e9a021d5434c1e1ce3af23286278": "GPL-1.0-only",
    "ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697": "GPL-1.0-only",
    "b80c75f62f77e4b5c92f32edee9a5be7c924cc651474d90840fecc602674a983": "GPL-1.0-only",
    "c0734228e33375b72256fed50d8056b50049dff71f408765af98cd4384a7434a": "GPL-1.0-only",
    "d3f2fd6ccabfae9813d009b1230c846c9d2184c61967399bebf30901e2c80155": "GPL-1.0-only",
    "dc7236e1d58f9deece1952757bfb31b866953fdec9efb7d34c62a79b880d7392": "GPL-1.0-only",
    "e60a000fbaef814103988b7923361d9a162470230b0603ec0922d6cc8564b736": "GPL-1.0-only",
    "ee41c15ce7d9cf5f29010590a0e4f4a6412fc1af33c10f280017db3f1fa0921b": "GPL-1.0-only",
    "efcbd5d5f621ec465277efcb03890a7fae6d9253e17b05ef7d7c6f90729a0fc9": "GPL-1.0-only",
    "075bcb76902921614c275e6562daee18b3c9f48b9c4c92b8b99ba3df00093abb": "GPL-2.0-only",
    "1188bd946c8b086fe6ea384131bc5e4725728e74e0fe1902762c9c87ec4bd36a": "GPL-2.0-only",
    "1d3015d0c95ac4c468939c7dc58e73a3f73a8592aa68d2af118ce60740773df7": "GPL-2.0-only",
    "2abe4f2f5ebff4aa8ed567a0cea0b9820cd074d9d7eda91d90df08701b51faa2": "GPL-2.0-only",
    "37d5ffb67b9a128c3369e6bf2bb7b990ff212dcd086585e0319ff7ce55988d1f": "GPL-2.0-only",
    "3f6302b11b06e2ba13b2ac80ac77a1979662ab69ce0b459e03a0238dd35d3518": "GPL-2.0-only",
    "403ef646951799380f6649a9a9c05cad95d64f4003a8c7476b27b490acddcf33": "GPL-2.0-only",
    "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3": "GPL-2.0-only",
    "58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd": "GPL-2.0-only",
    "5f3bcd48294d593b7647e36010d614bf45bfe3e5950aa6673782a092bbacc1af": "GPL-2.0-only",
    "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808": "GPL-2.0-only",
    "6e18512edfd0364936194ced5792e417e972b66df15a6f0f3b2b7cd330ed4a3a": "GPL-2.0-only",
    "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25": "GPL-2.0-only",
    "8bce3c0010045bb9ea13c8025ec3c58d82fddf2d6f2f7a01d807e27da9edc024": "GPL-2.0-only",
    "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2": "GPL-2.0-only",
    "95aeb819f45bf6639f460cc0ba5fa250f81764324ef35320bf76fb9f99428fc1": "GPL-2.0-only",
    "97d5465462f2eceba0aa8f8ce38d8f9e7987e238f6fadb61dbe4f34b3a49029c": "GPL-2.0-only",
    "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1": "GPL-2.0-only",
    "a96310c0126886e41d533f45005d1a2f38ac925a3bfaef1a8130b81d073307d0": "GPL-2.0-only",
    "aa75d54e4fbfdf0a9492e3f5d4ad1f93867a5fdd23c216c603d22461524ce1ce": "GPL-2.0-only",
    "ac164c60817349dc341fb503710f678c9f8afc5af87c7534931cf1bcd6e31e13": "GPL-2.0-only",
    "acaf68e303fe7610fff5b930bace57b87821d132bc434f4a104512da48f8bb6c": "GPL-2.0-only",
    "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774": "GPL-2.0-only",
    "b1db576b0501c5696808df9f75d6c49f526e764a8f5a6dc589439bdd50b426b0": "GPL-2.0-only",
    "ba8b5323b72bf2f2c5d07074133b38292e0fa23fde8fa48771ba8a04cccacddd": "GPL-2.0-only",
    "cc5e906da6be25c1bd7043d43b6ae593952ed18b205716a7cd5c93213491d778": "GPL-2.0-only",
    "d111d1c24a44c987fb91de3ce5aab3ec35d8061a2c8a41ffaa8bb64c47df6960": "GPL-2.0-only",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0-only",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0-only",
    "f285bc3733cac5b521b9507129b185a5f644847c954d9c5081d2405c9043b624": "GPL-2.0-only",
    "04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3": "GPL-3.0-only",
    "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191": "GPL-3.0-only",
    "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19": "GPL-3.0-only",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0-only",
    "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2": "GPL-3.0-only",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0-only",
    "07d2d80a87aec933ecf5a176fbea5e5427abb61db8822b2e934f6b861c5dc484": "LGPL-2.0-only",
    "084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2": "LGPL-2.0-only",
    "09bda551cd6a1058f0e9053b4e2fcc0bfb193e8bb1e1485734c5113235b4a30d": "LGPL-2.0-only",
    "2652838d994cbfd49626674c95d3dd21f6f86da9dcd7b97e2a33347147ba5323": "LGPL-2.0-only",
    "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2": "LGPL-2.0-only",
    "4ed7ee4d33f7dc376f7d218368e301b21dc31fee62f8d91352bf479d05a66ad1": "LGPL-2.0-only",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0-only",
    "542237188ef845a737d1eab5621ecfea8c3310f513f6ff72ad59d1d500e84b63": "LGPL-2.0-only",
    "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b": "LGPL-2.0-only",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0-only",
    "61cbce1ad10d3b01d130a67aa9d339b8e0f260e773fe0383e51c1d9022ce9ede": "LGPL-2.0-only",
    "6e6982d8bb4468c5ce7a88e400f1540201513f39e8dd96e3607ee631b813c06f": "LGPL-2.0-only",
    "736aa88e50cf3c3ea93c80a3b9a349833dd1b381c6a9c336770f2c61822e164a": "LGPL-2.0-only",
    "737725713ce1bc043b456db251ef38d2e9a28a7033b47d1fc7b5a7eb47feb0d8": "LGPL-2.0-only",
    "73dbe68688642ea8753271a313d85ca880b4dc28379e1b21b2615f96758c5210": "LGPL-2.0-only",
    "81ecf332fc652bb79c23397a1431c72d1f39f01ffdcec61843942283b44f4688": "LGPL-2.0-only",
    "936eb024285b788f0eddbf96826d70da1adefa3099b0ec5336ffe495c00b7798": "LGPL-2.0-only",
    "aa06ce7f6e464e73e65ec0efa0bc575ef5bb7059ae0137ab610c2e57b32ca95c": "LGPL-2.0-only",
    "ad81fc738f377aeba41fc24738c2e644becc9d2b6dc33ae94d1d1b9c5658fdd8": "LGPL-2.0-only",
    "bdb969a377f6160f4ad0ed61171a77004650a9c2517d62828be29f35b6bf6b31": "LGPL-2.0-only",
    "cb25e5e1095347e992d553a6b90ba28c3eb94162214d5bcb01d79a61f270448e": "LGPL-2.0-only",
    "cbc927caf696ef44b2fbebe29ffa45a5fccf0a64c78f2b85678a11032ebb3318": "LGPL-2.0-only",
    "cd0909403712694c9ea18a84f7dbb5d566c041db3dbd0e334cd930c31dfea7df": "LGPL-2.0-only",
    "cfdb5c66c66bf96ca974b33dd3db756e6c7eb3329f999c38c122137bdb4be319": "LGPL-2.0-only",
    "d40504a2bf1a1a86ee76e642ced31126577d21774b1ac0a222ce730ec78d7108": "LGPL-2.0-only",
    "d8f786929d4cd5e353f34a8b5fff503ac6cad8e24ee35ceb9eea0d2298b7b4ef": "LGPL-2.0-only",
    "dc842683831d008ff5f32600206cfd765e4d05df71fe831b1b4b31462fa2fff1": "LGPL-2.0-only",
    "e3486a0000bbe009f718d654729c9fbce91815811f5429e302cbc6cf9f016320": "LGPL-2.0-only",
    "f0daec6a0f573603d63948a57e952939050886941e593ad62f992f20e0a12443": "LGPL-2.0-only",
    "feb45efa998ac9d6ca85b1b2b7dfb124a14b1e88f579d2de38fe3a7970ce7380": "LGPL-2.0-only",
    "081a6ecff0c8e50ab92b129954441c5d8fbc8f1f5a8987bf8d9225cde97aee2c": "LGPL-2.1-only",
    "0de2e3ba00ed5f309ce9d71663e50ea414063f6e46865f2d80d4ad038f268c87": "LGPL-2.1-only",
    "127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd": "LGPL-2.1-only",
    "19fc4e6af7a00c932e4783857ac9feb3df9eebbae0ad3d2e4d3addc5101b7c16": "LGPL-2.1-only",
    "1d2a09e288311515cd0682b55db758224412a4901ca0578bf16420229d5190c4": "LGPL-2.1-only",
    "20136473d72f8fa2c8e3998adda1cf5676c9bac2bb48f059ee804302841a5fb5": "LGPL-2.1-only",
    "3bde1ca18489d8594a2c0c04b5ae1003c1795d1680675f4ef758325e1e1c3169": "LGPL-2.1-only",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1-only",
    "48e731def9111ee21e7b6b5dca5cb8e908fe999f7c1ef9175afef1e4c8a5e26a": "LGPL-2.1-only",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1-only",
    "580d668437368921310389889745ec2a76860b0f634a684ce33c6a4e5d106957": "LGPL-2.1-only",
    "5c42345581e1857951a2f5c540eae7981a9540e2d41028f448a195bb48dd33f0": "LGPL-2.1-only",
    "62470f8c7f6c88c1c89d5e4080fc0969a43f31055e91336c089eb0ad2152027b": "LGPL-2.1-only",
    "63a9e54a9c20816b2c240f12cda2ee7d6c9f2bfb426b706197a99f75ada62c9a": "LGPL-2.1-only",
    "67cbe3d9cde32d4b753be7e7e3df91788805606d7a3d154914ca1673f19e9c33": "LGPL-2.1-only",
    "77e5acffdb4b83d2e3ef8f1feb41cc7d5c859e0f7b2a31236b807ddc4248f9f5": "LGPL-2.1-only",
    "7cc1b31b95dd0bec1ff475bffceda6889681862c0b7d0da58cf97d3ae0a5d4bf": "LGPL-2.1-only",
    "925c28788af11361f32b5b10dbeb4454be64e8448ed4a7c0926618a5d8a85bfb": "LGPL-2.1-only",
    "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4": "LGPL-2.1-only",
    "a410900e6983c792f42e2267911d7570e409cfb8af0c9125ef02a022229ab14d": "LGPL-2.1-only",
    "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47": "LGPL-2.1-only",
    "b11e56f26e36c27490673d8fa272b68666cfd474b64e23db5244d0ccde21fa9e": "LGPL-2.1-only",
    "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb": "LGPL-2.1-only",
    "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df": "LGPL-2.1-only",
    "c9369494bc3c8d01995b30224c6aa0af52dd5fcb01230fbedb398a6d454a03bd": "LGPL-2.1-only",
    "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421": "LGPL-2.1-only",
    "e8379077377b4f1cf6d306654dca012e99fec5e9a13474071c353ba3557fc48b": "LGPL-2.1-only",
    "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f": "LGPL-2.1-only",
    "f0b3313d45a8a467f987a040dc16addaea95621fdaededc28db994fccd572d0e": "LGPL-2.1-only",
    "fe1e4e79e75a761f9e18e6c55697cba51fe044489eb12d24fd4231b83ef47132": "LGPL-2.1-only",
    "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7": "LGPL-3.0-only",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0-only",
    "34386b9a926117ec1b973ef1b1ef8fba50be254811addc9f9659bcc5d5a096bf": "MPL-1.1",
    "4fbf4b1f3d8cf5d05e627fcb1b0dded60f72dbb2e5c2bc5bb929a8db71982f2d": "MPL-1.1",
    "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87": "MPL-1.1",
    "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6": "MPL-1.1",
    "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de": "MPL-2.0",
    "0f8014c9a247062f1d4991bef882109e9b6d0a3aaedb91f3fb687aad18f2c49b": "MPL-2.0",
    "138d5d37371c837d65d0bcda8343c3b8a5f3615e2da2ae639ca77424622f17ea": "MPL-2.0",
    "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3": "MPL-2.0",
    "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead": "MPL-2.0",
    "b5d7fb996f853e1d58c59300cbdf195ffcac70a313577aee945ec0dd3bf32dea": "MPL-2.0",
}
