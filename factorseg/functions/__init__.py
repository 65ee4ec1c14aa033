"""factorseg.functions"""
