"""factorseg.operators"""
