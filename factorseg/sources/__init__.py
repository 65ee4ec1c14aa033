"""factorseg.sources"""
