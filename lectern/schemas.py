"""The schema of styled runs."""

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,superscript:boolean,subscript:boolean,color:string,highlight:string>"
